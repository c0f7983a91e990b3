"""MinHash near-deduplication with odd sketches.

1. Every text becomes its set of shingle hashes, MinHash samples in bands, an odd sketch (the samples folded into a parity bitmap)
   and a parity bitmap of the whole set. Texts with equal sets share one class from here on.
2. Buckets of bands with the same members are met once. Inside a bucket, XOR population counts decide: the odd sketch drops pairs
   whose samples disagree too often for the threshold (a true link is lost with odds below 10^-9), the bitmap of the full set drops
   those whose symmetric difference is provably too large. What survives is emitted as a spanning forest, never as all pairs.
3. Links of the forest are confirmed on full sets, and components are found by repeated minimum and pointer jumping.
4. A second pass over the buckets emits the surviving pairs that still lie in different components, all of them; confirmed ones
   join the components. A forest edge that failed thus costs no link."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import query, read, stored

#: Samples per band and bands: two sets at similarity 0.85 share no bucket with odds of 4 in 10^7.
ROWS, BANDS = 4, 20
#: Bits of an odd sketch, and of the smallest bitmap of a full set.
ODD_BITS, LEAST_BITS = 256, 1024
#: Members compared in one go; a larger bucket is split, and blocks meet in twos.
BLOCK = 2048

_MIX1, _MIX2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = _mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * _BASE)
    return seed[:ROWS * BANDS], seed[ROWS * BANDS:] | np.uint64(1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased, words parted by ASCII white space); a shorter
    text is one shingle, one without words has none."""
    ws = text.encode().lower().split()          # on bytes both touch ASCII only
    if not ws:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _BASE + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def min_hashes(h: np.ndarray) -> np.ndarray:
    xor, times = _permutations()
    best = np.full(len(xor), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 512):
        best = np.minimum(best, ((h[i:i + 512, None] ^ xor) * times).min(axis=0))
    return best


def parity(bits: np.ndarray, size: int) -> bytes:
    return np.packbits((np.bincount(bits, minlength=size) & 1).astype(np.uint8)).tobytes()


def odd_sketch(samples: np.ndarray) -> bytes:
    tagged = _mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * _BASE)
    return parity((tagged & np.uint64(ODD_BITS - 1)).astype(np.int64), ODD_BITS)


def set_bitmap(h: np.ndarray) -> bytes:
    size = max(LEAST_BITS, 1 << int(len(h) - 1).bit_length())
    return parity(((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), size)


def odd_estimate(differing_bits, samples: int = ROWS * BANDS, bits: int = ODD_BITS):
    """Jaccard similarity that a number of differing bits of two odd sketches speaks for."""
    left = np.maximum(1 - 2 * np.asarray(differing_bits) / bits, 1e-9)
    return 1 + bits / (4 * samples) * np.log(left)


@lru_cache(maxsize=8)
def most_differing(percent: int) -> int:
    """Differing bits beyond which a pair at the threshold is seen with odds below 10^-9: each sample that disagrees changes two bits
    at most, and the number of samples that disagree is binomial."""
    k, p = ROWS * BANDS, 1 - percent / 100
    chance = [1.0 * (1 - p) ** k]
    for i in range(1, k + 1):
        chance.append(chance[-1] * (k - i + 1) / i * p / (1 - p) if p < 1 else 0.0)
    tail = np.cumsum(chance[::-1])[::-1]
    return 2 * int(np.argmax(np.append(tail, 0) < 1e-9))


SKETCH = "n_shingles long, set_hi long, set_lo long, bands array<long>, odd binary, bitmap binary"


def sketched(docs: DataFrame, width: int) -> DataFrame:
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(SKETCH).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                n, hi, lo, bands, odd, maps = [], [], [], [], [], []
                for text in s.column(1).to_pylist():
                    h = shingle_hashes(text or "", width)
                    print_ = xxhash.xxh3_128_intdigest(h.tobytes())
                    n.append(len(h))
                    hi.append((print_ >> 64) - (1 << 63))
                    lo.append((print_ & ((1 << 64) - 1)) - (1 << 63))
                    if len(h):
                        m = min_hashes(h)
                        k = np.arange(1, BANDS + 1, dtype=np.uint64)
                        for row in m.reshape(BANDS, ROWS).T:
                            k = _mix(k * _BASE + row)
                        bands.append(k.view(np.int64))
                        odd.append(odd_sketch(m))
                        maps.append(set_bitmap(h))
                    else:
                        bands.append([])
                        odd.append(b"")
                        maps.append(b"")
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                                                  pa.array(odd, pa.binary()), pa.array(maps, pa.binary())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def survivors(n: np.ndarray, odd: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later ones (members come sorted by set size) that the sketches cannot tell apart at the threshold.
    ``side``: -1 throughout, or a block number; members of the same block were compared elsewhere."""
    size = np.array([len(m) for m in maps])
    table, rows = {}, {}
    for length in np.unique(size):
        own, twice = np.flatnonzero(size == length), np.flatnonzero(size == 2 * length)
        a = np.frombuffer(b"".join(maps[i] for i in own), np.uint8).reshape(len(own), length)
        if len(twice):      # the bit of a hash in the smaller bitmap is its bit in the larger one, modulo the size
            t = np.frombuffer(b"".join(maps[i] for i in twice), np.uint8).reshape(len(twice), 2, length)
            a = np.concatenate([a, t[:, 0] ^ t[:, 1]])
        table[length], rows[length] = a.view(np.uint64), np.concatenate([own, twice])
    bits = most_differing(percent)
    for x in range(len(n) - 1):
        end = np.searchsorted(n, n[x] * 100 // percent, "right")
        y = np.arange(x + 1, end)
        if side[x] >= 0:
            y = y[side[y] != side[x]]
        y = y[np.bitwise_count(odd[y] ^ odd[x]).sum(axis=1) <= bits]
        if not len(y):
            continue
        at = rows[size[x]]
        place = np.full(len(n), -1)
        place[at] = np.arange(len(at))
        a = table[size[x]]
        differ = np.bitwise_count(a[place[y]] ^ a[place[x]]).sum(axis=1).astype(np.int64)
        y = y[differ * (100 + percent) <= (100 - percent) * (n[y] + n[x])]
        if len(y):
            yield x, y


def compared(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``members`` (bucket, side, rep, comp, n, odd, bitmap), a bucket's rows side by side in one task, -> pairs (a, b), a < b: a forest of
    the surviving pairs of each bucket, or all surviving pairs of different components."""
    id_type = members.schema["rep"].dataType
    out = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        group.sort(key=lambda r: r[4])
        rep, comp, side = [r[2] for r in group], [r[3] for r in group], np.array([r[1] for r in group])
        if not forest and len(set(comp)) == 1 or side[0] >= 0 and (side == side[0]).all():
            return
        n = np.array([r[4] for r in group], np.int64)
        odd = np.frombuffer(b"".join(r[5] for r in group), np.uint64).reshape(len(group), -1)
        label = np.arange(len(group)) if forest else np.unique(np.array(comp), return_inverse=True)[1]
        for x, ys in survivors(n, odd, [r[6] for r in group], side, percent):
            ys = ys[label[ys] != label[x]]
            if forest:
                for y in sorted(ys.tolist(), key=rep.__getitem__):
                    if label[y] != label[x]:
                        label[label == label[y]] = label[x]
                        yield rep[x], rep[y]
            else:
                yield from ((rep[x], rep[y]) for y in ys.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            now, key = [], None
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if r[0] != key and now:
                        yield now
                        now = []
                    key = r[0]
                    now.append(r)
            if now:
                yield now
        found = []
        for g in groups():
            for p, q in pairs(g):
                found.append((p, q) if p < q else (q, p))
                if len(found) >= 20_000:
                    yield pa.RecordBatch.from_pylist([{"a": p, "b": q} for p, q in set(found)])
                    found = []
        if found:
            yield pa.RecordBatch.from_pylist([{"a": p, "b": q} for p, q in set(found)])

    dealt = members.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "side", "rep", "comp", "n_shingles", "odd", "bitmap")
    return dealt.mapInArrow(run, out).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").where((100 + percent) * both >= percent * (F.size("ha") + F.size("hb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id it reaches. Each round takes the smallest label among the neighbours
    and then the label of that label, so the rounds grow with the logarithm of a component's width."""
    sides = stored(links.select("a", "b").union(links.select("b", "a")), "near-links")
    now = stored(sides.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        met = (sides.join(now, sides.b == now.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("met")))
        best = now.join(met, "id").select("id", F.col("label").alias("old"), F.least("label", "met").alias("label"))
        jump = now.select(F.col("id").alias("label"), F.col("label").alias("next"))
        then = stored(best.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "near-labels")
        if then.where("old <> label").isEmpty():
            return then.select("id", "label")
        now = then.select("id", "label")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept for every row.

    Texts whose shingle sets have 100 * intersection >= ``percent`` * union are linked; component_id is the smallest doc_id reachable,
    and the row with it is kept. NULL, empty and blank texts have no shingles and are linked with nothing. Rows with one doc_id are
    one document. A row without doc_id can be linked with nothing: it is kept, its component_id is NULL. Empty tables give no
    rows; other columns are not read."""
    sk = stored(sketched(docs, width), "near-sketches")
    linked = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = linked.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"))
    own = (linked.join(reps, ["set_hi", "set_lo"]).where("doc_id = rep").select("rep", "n_shingles", "odd", "bitmap", "bands"))
    seen = own.select("rep", F.explode("bands").alias("bucket"))
    shape = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"),
                                       F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    unlike = shape.where("n > 1").groupBy("n", "lo", "hi", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    at = F.when(blocks > 1, F.pmod(F.xxhash64("rep"), blocks)).otherwise(-1).cast("int")
    meets = F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))
    spread = (seen.join(unlike, "bucket").withColumn("at", at).withColumn("with", F.explode(meets))
              .select(F.xxhash64("bucket", F.least("at", "with"), F.greatest("at", "with")).alias("bucket"), "rep",
                      # two different blocks meet across only; a block meets itself whole
                      F.when(F.col("at") == F.col("with"), -1).otherwise(F.col("at")).alias("side")))
    members = stored(spread.join(own.drop("bands"), "rep"), "near-members")
    forest = stored(compared(members.withColumn("comp", F.col("rep")), percent, True), "near-forest")
    asked = forest.select(F.col("a").alias("doc_id")).union(forest.select("b")).distinct()
    sets = stored(shingle_sets(docs.join(asked, "doc_id", "left_semi"), width), "near-sets")
    links = stored(confirmed(forest, sets, percent), "near-confirmed")
    label = components(links)
    among = members.join(label.select(F.col("id").alias("rep"), F.col("label").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    more = stored(confirmed(compared(among, percent, False), sets, percent), "near-more")
    if not more.isEmpty():
        label = components(links.union(more))
    classes = reps.join(label, reps.rep == label.id, "left").select("set_hi", "set_lo", F.coalesce("label", "rep").alias("component"))
    rows = sk.select("doc_id", "n_shingles", "set_hi", "set_lo")
    found = rows.join(classes, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return (found.select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they were."""
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                sets = [shingle_hashes(t or "", width).view(np.int64) for t in s.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(sets, pa.list_(pa.int64()))], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out).dropDuplicates(["doc_id"])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS o FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op3_minhash_near_dedup", SQL)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
