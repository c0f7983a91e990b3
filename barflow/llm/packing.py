"""Mixture-controlled packing: a deficit round-robin over one queue per source.

Queue s earns credit in proportion to its weight and is served a quantum of tokens each time its credit passes half of the next
one: the (j+1)-th at credit time (2j+1) / weight. Serving in the order of these times is the round-robin with its deficits carried
for ever, across windows and across partitions alike, and since the order is known in closed form, every task can tell where in
the global stream of tokens a quantum falls from the queue totals alone. Queues that have run dry drop out of the order, the
others share what is left in proportion. Windows are cut from the stream every ``window`` tokens, so only the last one has padding.

Only so many sources have a queue in the first round-robin. All others share one queue, which is itself the stream of a round-robin
over groups of sources, and so on down to single sources: a tree, of which a document needs the totals beside its own way up only."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.bpe import coder
from barflow.llm.common import query, read, stored

#: Weights are whole numbers up to this: products with quantum numbers up to 10^12 fit 64 bits.
_UNIT = 1 << 20
#: Children of a node of the tree below the shared queue.
FAN = 64
#: Rows up to which the totals per queue and part are sent to all tasks (about 100 bytes each); beyond, the ids are shuffled to them.
SENT_ROWS = 400_000


def queue_names(docs: DataFrame, targets: dict[str, float] | None, max_queues: int) -> list[str]:
    """The sources with a queue of their own: those of ``targets``, or the ``max_queues`` - 1 with most documents (ties by name). All
    others, and rows without a source, share one more queue."""
    if targets:
        return sorted(targets)
    top = (docs.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "source").limit(max_queues - 1).select("source"))
    return sorted(r[0] for r in top.collect())


def tokenised(docs: DataFrame, definition: str, pattern: str, end_id: int, names: list[str]) -> DataFrame:
    """doc_id, queue, rest (in the shared queue the source behind "=", or "-" where it has none; else empty), part, start (tokens of
    this queue and rest before it in its part), n, ids (little-endian). ``part`` numbers the task that made the row, so starts need no
    shuffle; the caller stores the table before using it, which fixes parts and starts together."""
    spec = docs.sparkSession.sparkContext.broadcast((definition, pattern, {s: i for i, s in enumerate(names)}))
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("queue", T.IntegerType()), T.StructField("rest", T.StringType()), T.StructField("part", T.LongType()),
                        T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, pattern, at = spec.value
        c, part, before = coder(definition, pattern), TaskContext.get().partitionId(), {}
        stop = np.array([end_id], c.dtype)
        for b in batches:
            for s in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                split = [c.pieces(t) for t in s.column(1).to_pylist()]
                codes = c.codes([p for x in split for p in x])
                ids = c.gather(codes)
                ends = np.concatenate([[0], np.cumsum(c.n_ids[codes])])[np.cumsum([0, *map(len, split)])]
                sources, starts, sizes, blobs = s.column(2).to_pylist(), [], [], []
                queues = [at.get(x, len(at)) for x in sources]
                rest = ["" if q < len(at) else "-" if x is None else "=" + x for q, x in zip(queues, sources)]
                for k, x, y in zip(zip(queues, rest), ends, ends[1:]):
                    blobs.append(np.concatenate([ids[x:y], stop]).tobytes())
                    starts.append(before.get(k, 0))
                    sizes.append(int(y - x) + 1)
                    before[k] = starts[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(queues, pa.int32()), pa.array(rest, pa.string()), pa.array([part] * s.num_rows, pa.int64()), pa.array(starts, pa.int64()),
                                                  pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=out.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source").mapInArrow(run, out)


class Order:
    """Where the quanta of each queue fall in the global stream. ``totals``: tokens of each queue; ``weights``: whole numbers > 0."""

    def __init__(self, totals: list[int], weights: list[int], quantum: int):
        self.n = np.array([-(-t // quantum) for t in totals], np.int64)          # quanta of each queue, the last perhaps short
        self.missing = np.array([-t % quantum for t in totals], np.int64)
        self.w, self.quantum = np.array(weights, np.int64), quantum

    def positions(self, q: int, j: np.ndarray) -> np.ndarray:
        """First token of quantum ``j`` of queue ``q``: quanta served earlier, less what the short ones among them lack."""
        later = np.arange(len(self.w)) >= q
        out, step = [np.zeros(0, np.int64)], max(1, (1 << 18) // len(self.w))
        for own in (j[i:i + step, None] for i in range(0, len(j), step)):
            # quanta i of queue t with (2i + 1) / w_t before (2j + 1) / w_q; ties go to the lower queue number
            earlier = (((2 * own + 1) * self.w - later) // self.w[q] + 1) // 2
            earlier[:, q] = own[:, 0]
            earlier = np.minimum(earlier, self.n)
            out.append((earlier * self.quantum - np.where((earlier == self.n) & (self.n > 0), self.missing, 0)).sum(axis=1))
        return np.concatenate(out)


def weights_of(shares: list[float]) -> list[int]:
    return [max(1, round(s * _UNIT)) for s in shares]


def lifted(order: Order, starts: np.ndarray, sizes: np.ndarray, queues: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of queues in the stream that ``order`` makes of them: (row, start in the stretch, length, place in the stream). Quanta of
    a stretch that follow each other in the stream are one."""
    q = order.quantum
    first, last = starts // q, (starts + sizes - 1) // q
    n = last - first + 1
    row = np.repeat(np.arange(len(starts)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    lo, hi = np.maximum(j * q, starts[row]), np.minimum((j + 1) * q, starts[row] + sizes[row])
    at = np.zeros(len(j), np.int64)
    for k in np.unique(queues):
        mine = queues[row] == k
        at[mine] = order.positions(int(k), j[mine]) + lo[mine] - j[mine] * q
    length = hi - lo
    joined = np.zeros(len(j), bool)
    joined[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + length[:-1])
    head = np.flatnonzero(~joined)
    length = np.add.reduceat(length, head) if len(head) else length
    row, lo, at = row[head], lo[head] - starts[row[head]], at[head]
    return row, lo, length, at


def windowed(window: int, row: np.ndarray, lo: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches cut at the ends of windows: (row, start in the document, length, place in the global stream)."""
    w0 = at // window
    k = (at + length - 1) // window - w0 + 1
    src = np.repeat(np.arange(len(at)), k)
    w = w0[src] + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    a, z = np.maximum(w * window, at[src]), np.minimum((w + 1) * window, at[src] + length[src])
    return row[src], lo[src] + a - at[src], z - a, a


def climbed(routes: list, starts: np.ndarray, sizes: np.ndarray, quantum: int) -> tuple[np.ndarray, ...]:
    """Documents in the stream of the queue at the top of their routes: (row, start in the document, length, place). A route names, from
    the source up, the child that is left and the totals of all children of the node above; None stands for the top itself."""
    row, lo, size, at = np.arange(len(starts)), np.zeros(len(starts), np.int64), sizes, starts
    level = 0
    while True:
        moving: dict[tuple, list[int]] = {}
        for i, r in enumerate(row.tolist()):
            if routes[r] and level < len(routes[r]):
                moving.setdefault(tuple(routes[r][level]["totals"]), []).append(i)
        if not moving:
            return row, lo, size, at
        still = np.ones(len(row), bool)
        parts = []
        for totals, mine in moving.items():
            mine = np.array(mine)
            still[mine] = False
            order = Order(list(totals), weights_of([t / sum(totals) for t in totals]), quantum)
            child = np.array([routes[r][level]["child"] for r in row[mine].tolist()])
            r, a, n, place = lifted(order, at[mine], size[mine], child)
            parts.append((row[mine][r], lo[mine][r] + a, n, place))
        row, lo, size, at = (np.concatenate(x) for x in zip((row[still], lo[still], size[still], at[still]), *parts))
        level += 1


def routes_below(per_part: DataFrame, n_rest: int) -> DataFrame:
    """rest, route: the way of every source of the shared queue to it, see ``climbed``. One row per source, with the totals of ``FAN``
    sources or so per level."""
    groups = -(-n_rest // FAN)
    kids = F.array_sort(F.collect_list(F.struct("child", "n")))      # FAN children on average, by hash
    def nodes(children: DataFrame) -> DataFrame:
        return (children.groupBy("node").agg(kids.alias("kids"), F.sum("n").alias("whole"))
                .select("node", "whole", F.posexplode("kids").alias("at", "kid"), F.transform("kids", lambda k: k["n"]).alias("totals"))
                .select("node", "whole", F.col("kid.child").alias("child"), F.array(F.struct(F.col("at").alias("child"), "totals")).alias("step")))
    level = nodes(per_part.groupBy(F.col("rest").alias("child")).agg(F.sum("n").alias("n")).withColumn("node", F.pmod(F.xxhash64("child"), F.lit(groups))))
    routes = level.select(F.col("child").alias("rest"), "node", F.col("step").alias("route"))
    while groups > 1:
        up = nodes(level.select(F.col("node").alias("child"), F.col("whole").alias("n")).distinct().withColumn("node", F.floor(F.col("child") / FAN)))
        routes = (routes.withColumnRenamed("node", "child").join(up, "child").select("rest", "node", F.concat("route", "step").alias("route")))
        level, groups = up, -(-groups // FAN)
    return routes.select("rest", "route")


def pack(docs: DataFrame, definition: str, pattern: str, window: int = 1024, targets: dict[str, float] | None = None, quantum: int = 128,
         end_id: int = 0, max_queues: int = 64) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its token ids and ``end_id``; every id lies in exactly one piece, every sequence but the last is full and gapless.
    ``targets``: weight per source (rows of other sources together weigh as much as their share of tokens); by default every source
    weighs its share of all tokens, so each stretch of windows mirrors the corpus. Any number of sources and targets: those with a queue
    of their own (all targets, or the ``max_queues`` - 1 largest sources) keep within two quanta of their share, the others within two
    quanta per level of the tree that shares the last queue. NULL and empty texts are ``end_id`` alone; rows without a source are a source;
    repeated rows are packed one by one; empty tables give no rows; other columns are not read."""
    spark = docs.sparkSession
    names = queue_names(docs, targets, max_queues)
    rows = stored(tokenised(docs, definition, pattern, end_id, names), "packing-ids")
    per_part = rows.groupBy("queue", "rest", "part").agg(F.sum("n").alias("n"))
    totals, n_parts, n_rest = [0] * (len(names) + 1), 0, 0
    for r in per_part.groupBy("queue").agg(F.sum("n").alias("n"), F.count("part").alias("parts"), F.countDistinct("rest").alias("rest")).collect():
        totals[r["queue"]] = r["n"]                                               # one row per queue of the first round-robin
        n_parts += r["parts"]
        n_rest = r["rest"] if r["queue"] == len(names) else n_rest
    whole = max(sum(totals), 1)
    shares = [t / whole for t in totals]
    if targets:
        named = sum(targets.values()) / max(1 - shares[-1], 1e-9)
        shares = [targets[s] / named for s in names] + shares[-1:]
    order = spark.sparkContext.broadcast(Order(totals, weights_of(shares), quantum))
    earlier = Window.partitionBy("queue", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.withColumn("carried", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    if n_parts <= SENT_ROWS:
        carried = F.broadcast(carried)
    placed = rows.join(carried, ["queue", "rest", "part"]).withColumn("start", F.col("start") + F.col("carried"))
    columns, shared = ["doc_id", "queue", "start", "n", "ids", "route"], F.col("queue") == len(names)
    straight = placed.withColumn("route", F.lit(None).cast("array<struct<child:int,totals:array<bigint>>>"))
    if n_rest > 1:      # none of these sources is as large as a named one, so the join by source has no hot key
        routed = placed.where(shared).join(routes_below(per_part.where(shared), n_rest), "rest")
        placed = straight.where(~shared).select(columns).union(routed.select(columns))
    else:
        placed = straight.select(columns)
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in longs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                queues, starts, sizes = (s.column(i).to_numpy() for i in (1, 2, 3))
                row, lo, size, at = climbed(s.column(5).to_pylist(), starts, sizes, quantum)
                up, more, length, at = lifted(order.value, at, size, queues[row])
                row, start, length, at = windowed(window, row[up], lo[up] + more, length, at)
                blobs = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(s.column(4).to_pylist(), sizes.tolist())]
                crc = [zlib.crc32(memoryview(blobs[r])[4 * x:4 * (x + n)]) for r, x, n in zip(row.tolist(), start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64), sizes[row], at // window, at % window))],
                                                 names=out.names)

    return placed.mapInArrow(run, out)


def public_pack(docs: DataFrame) -> DataFrame:
    """Packing with the production settings of the query and of the pipeline."""
    import public_tokenizers as P
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return pack(docs, f.read(), P.PATTERN)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_pack(read(spark, sf_dir, "documents"))
