"""Token counts of documents of any length.

Short texts are counted whole. A huge one is cut into chunks that overlap, the chunks are spread over the tasks, and two
neighbours are spliced at a boundary that both found in their overlap. A cut between pieces depends on the text to its right alone
(the pattern never looks back), so from a common boundary on both chunks agree; the left chunk's last MARGIN characters, which
text beyond its end could change, don't count. Where an overlap holds no common boundary (a run of letters longer than it), the
document is counted with overlaps that double until every joint aligns."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.bpe import Coder, coder
from barflow.llm.common import query, read, stored

#: Characters at a chunk's end that may read otherwise with more text: the longest contraction and the longest added token.
MARGIN = 32


def edges(c: Coder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (characters) of all cuts between pieces, both ends included, and the tokens before each."""
    pieces = c.pieces(text)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    return at, np.concatenate([[0], np.cumsum(c.counts(pieces))])


def resynchronised(c: Coder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text by overlapping chunks, one after another in bounded memory. An overlap without a common boundary is
    doubled; one that reaches the end of the text is the rest of the text itself."""
    done, start, total = 0, 0, 0          # text[:done] is counted; the current chunk starts at a boundary
    while True:
        width = overlap
        while True:
            end = min(len(text), start + chunk + width)
            at, n = edges(c, text[start:end])
            if end == len(text):
                return total + int(n[-1])
            sure = at[at <= end - start - MARGIN]
            joint = max(start + chunk - width, start + 1)
            right, _ = edges(c, text[joint:end])
            common = np.intersect1d(sure + start, right + joint)
            common = common[common > done]
            if len(common):
                break
            width *= 2
        total += int(n[np.searchsorted(at + start, common[0])])
        start = done = int(common[0])


def token_counts(docs: DataFrame, definition: str, pattern: str, limit: int = 1024, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit for every row.

    ``definition``: text of the tokenizer's file. NULL and empty texts have no tokens. Repeated rows are counted one by one, empty
    tables give no rows, other columns are not read."""
    if overlap <= MARGIN // 2 or chunk <= 2 * overlap:
        raise ValueError("overlap must pass MARGIN / 2 and chunk twice the overlap")
    spec = docs.sparkSession.sparkContext.broadcast((definition, pattern))     # one vocabulary file, about 2 MB
    id_type = docs.schema["doc_id"].dataType
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = base.where(F.length("text") <= chunk)
    # the huge texts are few; written once, so that each row keeps its number
    long = stored(base.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "huge-texts")
    counted = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*spec.value)
        for b in batches:
            for s in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                split = [c.pieces(t) for t in s.column(2).to_pylist()]
                n = c.counts([p for x in split for p in x])
                ends = np.cumsum([0, *map(len, split)])
                sums = np.concatenate([[0], np.cumsum(n)])[ends]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(np.diff(sums), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*spec.value)
        for b in batches:
            for i in range(b.num_rows):
                n = resynchronised(c, b.column(2)[i].as_py(), chunk, 2 * overlap)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([n], pa.int64())],
                                                 names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    near = short.select("doc_id", n_bytes, "text").mapInArrow(whole, counted)

    cut_type = T.StructType([T.StructField("doc_id", id_type), T.StructField("row", T.LongType()), T.StructField("k", T.LongType()),
                             T.StructField("start", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("part", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                starts = [max(0, s - overlap) for s in range(0, len(text), chunk)]
                for k, s in enumerate(starts):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([k], pa.int64()), pa.array([s], pa.int64()),
                         pa.array([k == len(starts) - 1]), pa.array([text[s:(k + 1) * chunk + overlap]])], names=cut_type.names)

    zone = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType())]))
    edge_type = T.StructType([*cut_type.fields[:3], T.StructField("last", T.BooleanType()), T.StructField("n", T.LongType()),
                              T.StructField("bytes", T.LongType()), T.StructField("head", zone), T.StructField("tail", zone)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*spec.value)
        shape = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        for b in batches:
            heads, tails, sums, sizes = [], [], [], []
            for k, start, last, text in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                at, n = edges(c, text)
                at, sums, joint = at + start, [*sums, int(n[-1])], (k + 1) * chunk
                heads.append([{"at": int(x), "n": int(y)} for x, y in zip(at, n) if k and x < k * chunk + overlap])
                tails.append([] if last else [{"at": int(x), "n": int(y)} for x, y in zip(at, n) if joint - overlap <= x <= start + len(text) - MARGIN])
                own = text[k * chunk - start:] if last else text[k * chunk - start:joint - start]
                sizes.append(len(own.encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(heads, shape), pa.array(tails, shape)], names=edge_type.names)

    chunks = long.select("doc_id", "row", "text").mapInArrow(cut, cut_type).repartition("row", "k").mapInArrow(found, edge_type)
    after = Window.partitionBy("row").orderBy("k")
    joints = (chunks.withColumn("next", F.lead("head").over(after))
              .withColumn("p", F.array_min(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next", lambda x: x["at"])))))
    tokens_at = lambda col: F.filter(col, lambda x: x["at"] == F.col("p"))[0]["n"]
    spliced = joints.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("bytes").alias("n_bytes"),
        F.sum(F.when(F.col("last"), F.col("n")).when(F.col("p").isNotNull(), tokens_at("tail") - tokens_at("next"))).alias("n_tokens"),
        F.bool_and(F.col("last") | F.col("p").isNotNull()).alias("aligned"))
    seen = stored(spliced, "spliced")
    far = seen.where("aligned").select("doc_id", "n_bytes", "n_tokens")
    # whatever did not align: the whole document again, in one task, by chunks whose overlap widens
    again = long.join(seen.where("NOT aligned").select("row"), "row", "left_semi").select("doc_id", n_bytes, "text").mapInArrow(widened, counted)
    return near.unionByName(far).unionByName(again).withColumn("over_limit", F.col("n_tokens") > limit)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_counts(read(spark, sf_dir, "documents"), f.read(), P.PATTERN)
