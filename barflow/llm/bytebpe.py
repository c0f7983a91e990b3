"""Byte-level BPE encoding with offsets, and decoding by the reversed byte table, over Arrow batches."""
from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.bpe import byte_chars, coder, ranks_to_json
from barflow.llm.common import query, read, slices, tidy

_ROWS, _BYTES = 64, 1 << 19     # texts whose ids are held at once


def encode(docs: DataFrame, definition: str, pattern: str, offsets: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, ids (array of int) and, if ``offsets``, starts (array of int): for each id the
    character of the text that holds its first byte, so tokens that part a character name the same one.

    NULL and empty texts have no ids; repeated rows are encoded one by one; empty tables give no rows; other columns are not read."""
    spec = docs.sparkSession.sparkContext.broadcast((definition, pattern))      # one vocabulary file, about 2 MB
    id_type, ints = docs.schema["doc_id"].dataType, T.ArrayType(T.IntegerType(), False)
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", ints)] + [T.StructField("starts", ints)] * offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*spec.value)
        widths = np.diff(byte_table(spec.value[0])[1]) if offsets else None
        for s in (b.slice(x, y - x) for b in batches for x, y in slices(b.column(1), _BYTES, _ROWS)):
            texts = s.column(1).to_pylist()
            ids, ends = encoded(c, texts)
            yield pa.RecordBatch.from_arrays([s.column(0), lists(ids, ends)] + ([lists(starts_of(texts, ids, ends, widths), ends)] if offsets else []), names=out.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), out)


def encoded(c, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin and end among them)."""
    split = [c.pieces(t) for t in texts]
    codes = c.codes([p for x in split for p in x])
    per_piece = np.concatenate([[0], np.cumsum(c.n_ids[codes])])
    return c.gather(codes), per_piece[np.cumsum([0, *map(len, split)])]


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))


def starts_of(texts: list[str], ids: np.ndarray, ends: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Character of its text that holds the first byte of each token."""
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1           # continuation bytes belong to the character before
    n = widths[ids]
    before = np.cumsum([0, *map(len, texts)])[:-1]
    return char_of[np.cumsum(n) - n] - np.repeat(before, np.diff(ends))


@lru_cache(2)
def byte_table(definition: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids one after another, where each id's begin and end): the byte table read backwards; added tokens stand for their own
    text. Made once per worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    byte_of = {x: b for b, x in enumerate(byte_chars())}
    added = {x.content for x in t.get_added_tokens_decoder().values()}
    known = t.get_vocab(with_added_tokens=True)
    own = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        own[i] = token.encode() if token in added else bytes(byte_of[x] for x in token)
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])


def bytes_of(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of runs of ids one after another, where each run's begin and end among them)."""
    flat, first = table
    n = np.diff(first)[ids]
    to = np.cumsum(n)
    raw = flat[np.arange(to[-1] if len(to) else 0) + np.repeat(first[ids] - (to - n), n)]
    return raw, np.concatenate([[0], to])[ends]


def decode(rows: DataFrame, definition: str) -> DataFrame:
    """Adds ``bytes`` (binary) and ``text`` to rows with ``ids``. A character that tokens have parted is put together again; bytes
    that are no UTF-8 (a cut inside a character) become U+FFFD in ``text`` and stay as they are in ``bytes``. NULL ids give NULLs."""
    out = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())])
    spec, at = rows.sparkSession.sparkContext.broadcast(definition), rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(spec.value)
        for s in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            ids = s.column(at)
            sizes = np.array([0 if x is None else x for x in pc.list_value_length(ids).to_pylist()], np.int64)
            raw, ends = bytes_of(table, ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *sizes]))
            found = [raw[x:y].tobytes() if ok else None for x, y, ok in zip(ends, ends[1:], ids.is_valid().to_pylist())]
            text = [r if r is None else codecs.decode(r, "utf-8", "replace") for r in found]
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(found, pa.binary()), pa.array(text, pa.string())], names=out.names)

    return rows.mapInArrow(tidy(run), out)


def round_trip(docs: DataFrame, definition: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_tokens, ids_sha256 and starts_sha256 (over ids and ``encode``'s starts as little-endian unsigned 32-bit integers),
    decoded_sha256 (over the bytes that ``decode`` makes of the ids). Ids and bytes never leave the worker. Awkward rows as in ``encode``."""
    spec = docs.sparkSession.sparkContext.broadcast((definition, pattern))
    names = ["doc_id", "n_tokens", "ids_sha256", "starts_sha256", "decoded_sha256"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    digest = lambda values, ends: [hashlib.sha256(values[x:y].tobytes()).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, table = coder(*spec.value), byte_table(spec.value[0])
        widths = np.diff(table[1])
        for s in (b.slice(x, y - x) for b in batches for x, y in slices(b.column(1), _BYTES, _ROWS)):
            texts = s.column(1).to_pylist()
            ids, ends = encoded(c, texts)
            starts = starts_of(texts, ids, ends, widths)
            cols = [pa.array(np.diff(ends), pa.int64()), *(pa.array(digest(v.astype("<u4"), ends), pa.string()) for v in (ids, starts)),
                    pa.array(digest(*bytes_of(table, ids, ends)), pa.string())]
            yield pa.RecordBatch.from_arrays([s.column(0), *cols], names=names)

    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(tidy(run), f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, starts_sha256 string, decoded_sha256 string"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return round_trip(read(spark, sf_dir, "documents"), ranks_to_json(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.PATTERN)
