"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers who speaks, by Viterbi.

A state is a role together with "starts a turn" or "goes on". Start, transition and emission probabilities are smoothed counts over
all labelled lines. A conversation is decoded in blocks: each block is first a matrix (best score from any state before it to any
state at its end), a conversation's matrices are chained, and then each block is decoded between its two known ends. A conversation of
any length thus spreads over tasks, and the result is the one of the undivided algorithm."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import NON_SPACE, query, read, stored

ROLES = ["system", "user", "assistant"]
_K = 2 * len(ROLES)          # state 2r starts a turn of role r, 2r + 1 goes on with it
#: Speaker words of each role, the names first that ``transcribed`` writes.
SPEAKERS = [["system", "instructions", "context"], ["user", "human", "question", "q", "customer", "student"],
            ["assistant", "ai", "answer", "a", "bot", "agent", "teacher"]]
_MARKER = r"^[\s>*#\[(-]*([A-Za-z]{1,16})[\])*]*\s*[:>]\s*"
#: Marker classes (none, other speaker, the roles), length classes, question mark or not.
_SHAPE = (2 + len(ROLES), 5, 2)
#: Turns (or lines, whatever ``place`` counts) of a block.
BLOCK = 64


def transcribed(turns: DataFrame) -> DataFrame:
    """Raw transcript lines of ``turns`` (conv_id, turn, role, text): conv_id, turn, line, text, role (the label). One of three styles of
    speaker markers per conversation; every seventh turn after the first, by hash, has lost its marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3)).cast("int")
    name = F.coalesce(*[F.when(F.col("role") == r, F.initcap(F.array(*[F.lit(x) for x in SPEAKERS[i][:3]])[style])) for i, r in enumerate(ROLES)])
    lost = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0)
    marker = F.when(lost | name.isNull(), F.lit("")).otherwise(F.concat(name, F.lit(": ")))
    return (turns.select("conv_id", "turn", "role", marker.alias("_m"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "_t"))
            .select("conv_id", "turn", "line", F.when(F.col("line") == 0, F.concat("_m", "_t")).otherwise(F.col("_t")).alias("text"), "role"))


def featured(lines: DataFrame, block: int) -> DataFrame:
    """Adds the grouping keys, the feature classes of each line and its text without the marker."""
    word = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), _MARKER, 1))
    kind = F.when(word == "", 0)
    for i, names in enumerate(SPEAKERS):
        kind = kind.when(word.isin(names), 2 + i)
    n = F.length(F.coalesce("text", F.lit("")))
    length = F.when(~F.coalesce("text", F.lit("")).rlike(NON_SPACE), 0).when(n < 40, 1).when(n < 120, 2).when(n < 400, 3).otherwise(4)
    place = F.coalesce(F.col("turn"), F.lit(-1)).cast("long")
    return lines.select(
        "*", F.xxhash64("conv_id").alias("ck"), F.floor(place / block).cast("long").alias("block"), place.alias("place"),
        kind.otherwise(1).alias("marker"), length.alias("length"), F.coalesce("text", F.lit("")).rlike(r"\?\s*$").cast("int").alias("asks"),
        F.when(kind.otherwise(1) >= 2, F.regexp_replace(F.coalesce("text", F.lit("")), _MARKER, "")).otherwise(F.coalesce("text", F.lit(""))).alias("body"))


@dataclass
class Chain:
    start: np.ndarray           # log P of the first state
    step: np.ndarray            # log P of a state after a state
    emit: list[np.ndarray]      # for each feature: log P of its class in a state

    def lines(self, features: np.ndarray) -> np.ndarray:
        """Log P of each line's features in each state."""
        return sum(e[:, features[:, i]].T for i, e in enumerate(self.emit))


def fit(lines: DataFrame) -> Chain:
    """Smoothed counts over all labelled lines (``featured``, with role): a few dozen numbers reach the driver."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    known = lines.where(F.col("role").isin(ROLES)).withColumn("r", role)
    emit = [np.ones((_K, n)) for n in _SHAPE]
    for g in known.groupBy("r", (F.col("line") > 0).cast("int").alias("goes_on"), "marker", "length", "asks").count().collect():
        for e, c in zip(emit, (g["marker"], g["length"], g["asks"])):
            e[2 * g["r"] + g["goes_on"], c] += g["count"]
    turns = known.groupBy("ck", "place").agg(F.min("r").alias("r"), F.max("line").alias("last"))
    after = turns.select("ck", (F.col("place") - 1).alias("place"), F.col("r").alias("next"))
    start, step = np.ones(_K) * 1e-3, np.ones((_K, _K)) * 1e-3
    for g in (turns.join(after, ["ck", "place"], "left").groupBy("r", "next", (F.col("place") == 0).alias("first"), F.least("last", F.lit(2)).alias("last"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("last").alias("lines")).collect()):
        b, n, last = 2 * g["r"], g["n"], g["last"]
        start[b] += n * bool(g["first"])
        step[b, b + 1] += n * (last > 0)
        step[b + 1, b + 1] += g["lines"] - n * (last > 0)
        if g["next"] is not None:
            step[b + (last > 0), 2 * g["next"]] += n
    return Chain(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(e / e.sum(1, keepdims=True)) for e in emit])


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first ``n_keys`` columns, which the partition holds side by side."""
    now: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if now and r[:n_keys] != now[0][:n_keys]:
                yield now
                now = []
            now.append(r)
    if now:
        yield now


def packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for r in rows:
        kept.append(r)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)


def block_matrix(chain: Chain, features: np.ndarray, first: bool) -> np.ndarray:
    """Best log score from each state before the block (rows) to each state at its end; in a first block all rows are alike."""
    e = chain.lines(features)
    v = (np.repeat(chain.start[None], _K, 0) if first else chain.step) + e[0]
    for x in e[1:]:
        v = (v[:, :, None] + chain.step[None]).max(1) + x
    return v


def block_path(chain: Chain, features: np.ndarray, before: int, end: int) -> list[int]:
    """Best states of a block's lines between the state before it (-1: none) and the one at its end."""
    e = chain.lines(features)
    v, back = (chain.start if before < 0 else chain.step[before]) + e[0], []
    for x in e[1:]:
        all_ = v[:, None] + chain.step
        back.append(all_.argmax(0))
        v = all_.max(0) + x
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def parse(lines: DataFrame, chain: Chain | None = None, block: int = BLOCK) -> DataFrame:
    """``lines`` (conv_id, turn, line, text, and role where ``chain`` is to be fitted) -> conv_id, turn, line, role (recovered), starts,
    rendered: the conversation's rows, in order, put together give it in canonical form, each turn as ``<|role|>``, its text, ``<|end|>``.

    Lines follow each other by (turn, line); equal ones by text. A transcript without turn numbers has its line number as ``turn`` and 0 as
    ``line``. NULL text is an empty line, a NULL turn comes first, rows with a NULL conv_id are one conversation, unknown roles are not
    learnt from. Repeated rows are lines of their own; empty tables give no rows; other columns are not read."""
    cols = ["conv_id", "turn", "line", "text"] + ["role"] * (chain is None)
    rows = stored(featured(lines.select(*cols), block), "transcript-lines")
    shared = lines.sparkSession.sparkContext.broadcast(chain or fit(rows))          # fewer than 200 numbers
    keys, feats = ["ck", "block"], ["marker", "length", "asks"]
    order = ["place", "line", "text", "turn"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ck", pa.int64()), ("block", pa.int64()), ("chained", pa.list_(pa.float64())), ("alone", pa.list_(pa.float64()))])
        def each():
            for g in runs(batches, 2):
                f = np.array([r[2:5] for r in g])
                yield g[0][0], g[0][1], block_matrix(shared.value, f, False).ravel().tolist(), block_matrix(shared.value, f, True)[0].tolist()
        yield from packed(each(), schema)

    scored = (rows.select(*keys, *feats, *order).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *feats)
              .mapInArrow(matrices, "ck long, block long, chained array<double>, alone array<double>"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ck", pa.int64()), ("block", pa.int64()), ("before", pa.int32()), ("end", pa.int32()), ("final", pa.bool_())])
        def each():
            for g in runs(batches, 1):
                v, back = np.array(g[0][3]), []
                for r in g[1:]:
                    all_ = v[:, None] + np.array(r[2]).reshape(_K, _K)
                    back.append(all_.argmax(0))
                    v = all_.max(0)
                path = [int(v.argmax())]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                path = [-1, *path[::-1]]
                for i, r in enumerate(g):
                    yield r[0], r[1], path[i], path[i + 1], i == len(g) - 1
        yield from packed(each(), schema)

    # one row per BLOCK turns of a conversation
    chained = scored.repartition("ck").sortWithinPartitions(*keys).mapInArrow(ends, "ck long, block long, before int, end int, final boolean")

    conv_type, turn_type = (lines.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    joined = rows.join(chained, keys).select(*keys, *feats, "before", "end", "final", "conv_id", "turn", "line", "body", "place", "text")
    dealt = joined.repartition(*keys).sortWithinPartitions(*keys, *order).drop("place", "text")
    conv_arrow, turn_arrow = (pa.schema(_arrow_schema(lines.select(c))).types[0] for c in ("conv_id", "turn"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv_arrow), ("turn", turn_arrow), ("line", pa.int32()), ("role", pa.string()), ("starts", pa.bool_()), ("rendered", pa.string())])
        def each():
            for g in runs(batches, 2):
                path = block_path(shared.value, np.array([r[2:5] for r in g]), g[0][5], g[0][6])
                for i, (r, s) in enumerate(zip(g, path)):
                    first = r[5] < 0 and i == 0
                    starts = s % 2 == 0 or first
                    head = ("" if first else "\n<|end|>\n") + f"<|{ROLES[s // 2]}|>\n" if starts else "\n"
                    yield r[8], r[9], r[10], ROLES[s // 2], starts, head + r[11] + ("\n<|end|>" if r[7] and i == len(g) - 1 else "")
        yield from packed(each(), schema)

    return dealt.mapInArrow(decoded, f"conv_id {conv_type}, turn {turn_type}, line int, role string, starts boolean, rendered string")


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


@query("op8_transcripts")
def op8_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(transcribed(read(spark, sf_dir, "conversations")))
