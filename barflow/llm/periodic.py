"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q and length at least max(``MIN_WORDS``, ``MIN_TURNS`` * q). Each word of a run
occurs in it ``MIN_TURNS`` times or more, so a word that is rarer than that within its segment lies in no run: it splits the segment. The
parts are counted anew until no segment splits any more. What survives is scanned for constant lags: at level w = 1, 2, 4, ... every
w-gram has a number, and its lag is the distance to its next occurrence. Within a run of period q, w/2 < q <= w, each w-gram recurs after q
words and not before (a shorter lag would be a shorter period), and just outside it does not: the runs are exactly the stretches of
constant lag. Grams that occur once leave the scan, as every longer gram that begins there occurs once too. A segment of n words costs
n log^2 n at most, whatever its words; no lag and no text is left out."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import query, read, slices, words

MIN_WORDS, MIN_TURNS = 24, 3
#: Bytes of text that are scanned together (a longer text is scanned alone).
SLICE = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(the place of the first equal word of the same text, for each word of all texts; the texts' ends)."""
    ends = np.cumsum([0, *map(len, texts)])
    codes = np.empty(ends[-1], np.int64)
    for ws, a, b in zip(texts, ends.tolist(), ends[1:].tolist()):
        codes[a:b] = np.fromiter(map({}.setdefault, ws, range(a, b)), np.int64, b - a)
    return codes, ends


def pieces(at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The number of each place's stretch of neighbouring places in one segment, counted from 0."""
    return np.cumsum(np.concatenate([[False], (np.diff(at) != 1) | (np.diff(segment) != 0)])) if len(at) else at


def survivors(codes: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the word within its segment, end of the segment) of the segments in which every word occurs ``min_turns``
    times or more. Only segments that have just been split are counted again."""
    at, name = np.arange(len(codes)), codes
    segment = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    done = []
    while len(at):
        size = np.bincount(segment)
        room = size[segment] >= min_words
        rare = (np.bincount(name)[name] < min_turns) & room
        broken = np.bincount(segment[rare], minlength=len(size)) > 0
        whole = room & ~broken[segment]
        if whole.any():
            seg = segment[whole]
            last = np.zeros(len(size), np.int64)
            last[seg] = at[whole]                       # places ascend, so the last one stays
            done.append((at[whole], name[whole], last[seg] + 1))
        on = room & broken[segment] & ~rare
        at, name, segment = at[on], name[on], pieces(at[on], segment[on])
        if len(at):
            _, name = np.unique(segment * (name.max() + 1) + name, return_inverse=True)
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lift = np.cumsum([0, *(int(n.max()) + 1 for _, n, _ in done)])       # names of different rounds stay apart
    at, name, end = (np.concatenate(x) for x in zip(*((a, n + u, e) for (a, n, e), u in zip(done, lift))))
    order = np.argsort(at, kind="stable")
    return at[order], name[order], end[order]


def lag_scan(at: np.ndarray, name: np.ndarray, end: np.ndarray, min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> np.ndarray:
    """Rows (start, length, period) of all runs in the segments, by start and period. ``name``: equal for equal words of one segment."""
    found, width = [np.zeros((0, 3), np.int64)], 1
    place = np.full(int(at[-1]) + 1 if len(at) else 0, -1, np.int64)      # of a position in ``at``
    while len(at):
        order = np.argsort(name, kind="stable")
        again = name[order[1:]] == name[order[:-1]]
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][again]] = (at[order[1:]] - at[order[:-1]])[again]
        here = np.flatnonzero((lag > width // 2) & (lag <= width))
        if len(here):
            cut = np.flatnonzero((np.diff(at[here]) != 1) | (np.diff(lag[here]) != 0))
            first, last = here[np.concatenate([[0], cut + 1])], here[np.concatenate([cut, [len(here) - 1]])]
            period = lag[first]
            length = at[last] - at[first] + width + period
            good = length >= np.maximum(min_words, min_turns * period)
            found.append(np.stack([at[first], length, period], 1)[good])
        # grams of twice the width, where both halves recur
        recurs = np.zeros(len(at), bool)
        recurs[order[:-1][again]] = recurs[order[1:][again]] = True
        place[:] = -1
        place[at[recurs]] = np.flatnonzero(recurs)
        i = np.flatnonzero(recurs & (end - at >= 2 * width))
        j = place[at[i] + width]
        i, j = i[j >= 0], j[j >= 0]
        pair = name[i] * (int(name.max()) + 1) + name[j]
        at, end = at[i], end[i]
        name = np.unique(pair, return_inverse=True)[1] if len(i) else i
        width *= 2
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> list[np.ndarray]:
    """For each text, given as words: its runs (start, length, period)."""
    codes, ends = numbered(texts)
    rows = lag_scan(*survivors(codes, ends, min_words, min_turns), min_words, min_turns)
    of = np.searchsorted(ends, rows[:, 0], "right") - 1       # empty texts end where they start and own no place
    rows[:, 0] -= ends[of]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def collapsed(ws: list[bytes], rows: np.ndarray) -> bytes:
    """The words that are left when every run keeps its first period."""
    if not len(rows):
        return b" ".join(ws)
    start, length, period = rows.T
    depth = np.zeros(len(ws) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join(ws[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist())


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed: the
    text's words, one space between them, without those that any run contains after its first period. ``min_turns`` is 3 or more.

    NULL, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated rows and a NULL doc_id are treated row by row; a very
    long text is scanned alone in its task; empty tables give no rows; other columns are not read."""
    if min_turns < 3:
        raise ValueError("min_turns must be 3 or more: below, a lag of one gram does not prove a run")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            for x, y in slices(b.column(1), SLICE):
                split = [t.split() for t in b.column(1).slice(x, y - x).to_pylist()]       # at the six ASCII white-space characters
                found = runs_of(split, min_words, min_turns)
                flat, ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(c), pa.int64()) for c in flat.T], fields=list(kind.value_type)))
                left = pa.array([collapsed(ws, r) for ws, r in zip(split, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array([len(ws) for ws in split], pa.int64()), rows, left],
                                                  names=["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string"))


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a periodic tail in every tenth document by the CRC of its id: h = crc32(id), g = h div 10, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8) of n words; words from number a on repeat the p words there. The rest as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    ws = words(text)
    n = F.size(ws)
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)).cast("long")).cast("int")
    p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
    tail = F.slice(again, F.lit(1), n - a)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.concat_ws(" ", F.slice(ws, F.lit(1), a), tail)).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    # doubles order length / period exactly: numerators and denominators of below 2^26 words
    best = F.array_max(F.transform("runs", lambda r: F.struct((r.length / r.period).alias("turns"), (-r.start).alias("s"), (-r.period).alias("q"),
                                                              r.length.alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    return (periodic_runs(docs).withColumn("_b", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.length").alias("length"),
                    (-F.col("_b.q")).alias("period"), F.floor(1000 * F.col("_b.length") / -F.col("_b.q")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
