"""Document fingerprints by one-permutation MinHash.

Each shingle of a text is hashed once; the upper bits of the hash name its bin, the rest is its value, and a bin keeps its smallest value.
An empty bin is filled by optimal densification: it asks bins in an order that depends on its own number and the attempt alone, until one
is filled from the text itself, and takes that value. The ``BITS`` lowest bits of each bin are packed. Of two sets with likeness J, a bin
agrees with odds J + (1 - J) / 2^BITS, from which ``likeness`` solves for J; its standard deviation is 0.02 at J = 0.5 with the default
1,024 bins of 2 bits (256 bytes)."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import query, read, slices, stored, tidy

BINS, BITS, SHINGLE = 1024, 2, 5
#: Bytes of text, and rows, that are hashed together (a longer text is hashed alone).
SLICE, ROWS = 1 << 19, 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))      # A-Z only, as in the near-duplicate operator
# The finalizer of the splitmix64 generator and its increment.
_GAMMA, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """The hash of each word that a worker has met, so far as they are ``MOST`` or fewer."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def shingle_hashes(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, the texts' ends among them). A text with fewer words than ``width`` is one shingle, one without
    words has none."""
    if len(_hashes) > _hashes.MOST:
        _hashes.clear()
    split = [t.translate(_LOWER).split() for t in texts]
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
    n = np.array([len(ws) for ws in split], np.int64)
    ends = np.cumsum(n)
    made = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        made = made * _GAMMA + h[k:k + len(made)]
    made = mixed(made + np.uint64(width))
    short = (n > 0) & (n < width)
    count = np.where(short, 1, np.maximum(n - width + 1, 0))
    out, to = np.empty(int(count.sum()), np.uint64), np.cumsum(count)
    full = count * ~short
    out[np.arange(full.sum()) + np.repeat(to - count - (np.cumsum(full) - full), full)] = \
        made[np.arange(full.sum()) + np.repeat(ends - n - (np.cumsum(full) - full), full)]
    for i in np.flatnonzero(short).tolist():
        one = np.zeros(1, np.uint64)
        for x in h[ends[i] - n[i]:ends[i]]:
            one = one * _GAMMA + x
        out[to[i] - 1] = mixed(one + np.uint64(n[i]))[0]
    return out, np.concatenate([[0], to])


def binned(hashes: np.ndarray, ends: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled): for each text (row) the smallest value of each bin, and whether a shingle of the text fell into it."""
    n_texts, shift = len(ends) - 1, np.uint64(65 - bins.bit_length())
    values = np.full(n_texts * bins, np.iinfo(np.uint64).max, np.uint64)
    cell = np.repeat(np.arange(n_texts) * bins, np.diff(ends)) + (hashes >> shift).astype(np.int64)
    np.minimum.at(values, cell, hashes)      # the bin's bits are alike within a cell
    filled = np.zeros(n_texts * bins, bool)
    filled[cell] = True
    return values.reshape(n_texts, bins), filled.reshape(n_texts, bins)


#: Asks of each bin that a worker holds ready.
ASKS = 256


def asked(bins: int, col: np.ndarray, first: int, n: int) -> np.ndarray:
    """The bins that each bin of ``col`` asks at its attempts first .. first + n - 1: a hash of both numbers."""
    seed = mixed(col.astype(np.uint64) * _GAMMA + np.uint64(1))
    return (mixed(seed[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * _GAMMA) & np.uint64(bins - 1)).astype(np.int16 if bins <= 1 << 15 else np.int64)


@lru_cache(4)
def ask_table(bins: int) -> np.ndarray:
    return asked(bins, np.arange(bins), 0, ASKS)


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Empty bins of each row take the value of the first filled bin that they ask; rows without any stay as they are. The fewer are left, the
    more attempts are looked at together."""
    bins, count, out = values.shape[1], filled.sum(1), values.copy()
    one = np.flatnonzero(count == 1)
    out[one] = values[one, filled[one].argmax(1)][:, None]        # wherever a bin asks, it ends there
    row, col = np.nonzero(~filled & (count > 1)[:, None])
    flat, at = filled.ravel(), 0
    while len(row):
        n = min(max(1, (1 << 16) // len(row)), ASKS - at % ASKS)
        ask = ask_table(bins)[col, at:at + n] if at < ASKS else asked(bins, col, at, n)
        hit = flat[(row * bins)[:, None] + ask]
        best = hit.argmax(1)
        found = hit[np.arange(len(row)), best]
        r, k = row[found], ask[found, best[found]]
        out[r, col[found]] = values[r, k]
        row, col, at = row[~found], col[~found], at + n
    return out


def low_bits(texts: list[bytes], bins: int = BINS, bits: int = BITS, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of each bin as small integers, one row per text; whether the text has shingles)."""
    hashes, ends = shingle_hashes(texts, width)
    values, filled = binned(hashes, ends, bins)
    # mixed with the bin once more: two different values agree in each bin by a chance of its own, also where few values fill many bins
    own = mixed(densified(values, filled) + np.arange(bins, dtype=np.uint64) * _GAMMA)
    return (own & np.uint64((1 << bits) - 1)).astype(np.uint8), filled.any(1)


def packed_bits(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Rows as bytes, ``bits`` per bin; a text without shingles has the empty fingerprint."""
    flags = (low[:, :, None] >> np.arange(bits - 1, -1, -1).astype(np.uint8)) & 1
    return [r.tobytes() if s else b"" for r, s in zip(np.packbits(flags.reshape(len(low), low.shape[1] * bits), axis=1), some.tolist())]


def unpacked(prints: list[bytes], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``packed_bits``."""
    some = np.array([len(p) > 0 for p in prints], bool)
    raw = np.frombuffer(b"".join(p or bytes(bins * bits // 8) for p in prints), np.uint8).reshape(len(prints), bins * bits // 8)
    flags = np.unpackbits(raw, axis=1).reshape(len(prints), bins, bits)
    return (flags << np.arange(bits - 1, -1, -1).astype(np.uint8)).sum(2, dtype=np.uint8), some


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> np.ndarray:
    """Estimated likeness of the sets behind two fingerprints, row by row, from 0 to 1: the share of bins that agree, corrected for
    those that agree by chance. Two texts without shingles are alike, one without and one with are not."""
    chance = 0.5 ** bits
    same = ((a[0] == b[0]).mean(1) - chance) / (1 - chance)
    return np.where(a[1] & b[1], np.clip(same, 0, 1), (~a[1] & ~b[1]).astype(float))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, fingerprint (binary of bins * bits / 8 bytes; empty where the text has no words). ``bins``: a
    power of two, 8 at least.

    Shingles are ``width`` words of the text with A-Z lower-cased, a shorter text is one shingle. NULL counts as empty; repeated rows
    are fingerprinted one by one, equal texts alike; a very long text is hashed alone; empty tables give no rows; other columns are not read."""
    if bins < 8 or bins & (bins - 1):
        raise ValueError("bins must be a power of two, 8 at least")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in slices(b.column(1), SLICE, ROWS):
                prints = packed_bits(*low_bits(b.column(1).slice(x, y - x).to_pylist(), bins, bits, width), bits)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(prints, pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, fingerprint binary")


def edited(text: str, other: str) -> str:
    """``text`` with its last third (of code points) replaced by as many of the first ones of ``other``, or all it has."""
    n = len(text) // 3
    return text[:len(text) - n] + other[:n]


_OUT = "doc_id {id}, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def with_next(ids: list, texts: list[str]) -> list[list]:
    """Columns of ``_OUT`` for all but the last of a stretch of neighbours."""
    now, n = low_bits([t.encode() for t in texts]), len(texts) - 1
    new = [edited(t, u).encode() for t, u in zip(texts, texts[1:])]
    then = low_bits(new)
    here, after = (now[0][:n], now[1][:n]), (now[0][1:], now[1][1:])
    return [ids[:n], [len(t) for t in texts[:n]], [hashlib.sha256(t).hexdigest() for t in new], packed_bits(*here), packed_bits(*then),
            likeness(here, then).tolist(), likeness(here, after).tolist()]


def table(schema: str, id_type: pa.DataType, cols: list[list]) -> pa.RecordBatch:
    """Lists as a batch with the columns that ``schema`` names."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "doc_id" else types[k]) for n, k, c in zip(names, kinds, cols)], names=list(names))


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document beside the next one by descending doc_id (after the last comes the first): doc_id, n_chars (code points),
    edited_sha256 (of ``edited``), fingerprint, edited_fingerprint, near_edited, near_next (``likeness`` to the edited text, to the next one).

    Texts move once: a range shuffle by doc_id, in which a partition's rows follow each other; only its first and its last row are
    put aside to meet those of the partitions beside it. NULL doc_ids come last, documents with equal ids follow by a hash of the
    text, repeated rows spread over partitions; NULL text counts as empty; a table of one row is its own neighbour; empty tables give no rows;
    other columns are not read."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("_r")]
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text")).withColumn("_r", F.monotonically_increasing_id())
            .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part")))
    out = (_OUT + ", part int, kind int, text string").format(id=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        for b in batches:
            for x, y in slices(b.column(1), SLICE, ROWS):
                ids, texts = b.column(0).slice(x, y - x).to_pylist(), b.column(1).slice(x, y - x).to_pylist()
                if first is None:
                    first, part = (ids[0], texts[0]), b.column(2)[x].as_py()
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = ids[-1], texts[-1]
                cols = with_next(ids, texts)
                yield table(out, b.column(0).type, [*cols, [part] * len(cols[0]), [0] * len(cols[0]), [None] * len(cols[0])])
        if first is not None:
            yield table(out, b.column(0).type, [[first[0], last[0]], *[[None, None]] * 6, [part, part], [1, 2], [first[1], last[1]]])

    seen = stored(rows.mapInArrow(tidy(run), out), "fingerprint-neighbours")
    heads, tails = seen.where("kind = 1"), seen.where("kind = 2").select("part", "doc_id", "text")
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)     # one small row per partition
    beside = (heads.select("part").withColumn("_first", F.first("part").over(parts))
              .withColumn("_next", F.coalesce(F.lead("part").over(Window.orderBy("part")), "_first")).select("part", "_next"))
    met = (tails.join(beside, "part").join(heads.select(F.col("part").alias("_next"), F.col("text").alias("next_text")), "_next")
           .select("doc_id", "text", "next_text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c for c in b.columns)):
                doc_id, text, after = (v.as_py() for v in row)
                yield table(_OUT, b.column(0).type, with_next([doc_id, None], [text, after]))

    return seen.where("kind = 0").drop("part", "kind", "text").unionByName(met.mapInArrow(tidy(close), _OUT.format(id=id_type)))


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", *[F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next")
