"""Line deduplication by a log-template tree, in DataFrame operations alone.

A line's way down the tree is fixed: its number of words, then its leading words one by one, ``DEPTH`` at most, where words with a
digit are a wildcard. A leaf is a template: the leading words and wildcards for what follows, as long as those leading words are at
least half of the line; longer lines must agree in all their words but the wildcards. Templates that recur across documents are
dropped everywhere but in the document with the smallest id that has them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import query, read, stored, words

DEPTH, MIN_WORDS, MIN_DOCS = 8, 4, 5
#: Boilerplate: documents from which on a line under MIN_WORDS words is dropped, and a literal line of LITERAL_WORDS words or more.
SHORT_DOCS, LITERAL_DOCS, LITERAL_WORDS = 5, 2, 10
WILDCARD = "<*>"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def leaf(line_words: Column, depth: int, min_words: int) -> Column:
    """Template of a line given as words: word count and the words that name its leaf; NULL for lines too short to be one."""
    n = F.size(line_words)
    named = F.slice(line_words, 1, F.when(n <= 2 * depth, F.least(n, F.lit(depth))).otherwise(n))
    return F.when(n >= min_words, F.xxhash64(n, named))


def exact_leaf(line_words: Column, min_words: int, literal_words: int) -> Column:
    """All words of a line that is short (odd values) or long (even values); NULL for the others and for blank lines."""
    n = F.size(line_words)
    short = (n > 0) & (n < min_words)
    even = F.shiftleft(F.shiftright(F.xxhash64(n, line_words), 1), 1)
    return F.when(short, even.bitwiseOR(F.lit(1))).when(n >= literal_words, even)


def templates(docs: DataFrame, depth: int, min_words: int, literal_words: int | None = None) -> DataFrame:
    """doc_id, key (of the row) and ``leaves``: the template of each line in order; with ``literal_words`` also ``exact``."""
    masked = F.transform(lines(F.col("text")), lambda x: F.when(
        x.rlike("[0-9]"), F.transform(words(x), lambda w: F.when(w.rlike("[0-9]"), WILDCARD).otherwise(w))).otherwise(words(x)))
    exact = [] if literal_words is None else [F.transform(lines(F.col("text")), lambda x: exact_leaf(words(x), min_words, literal_words)).alias("exact")]
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.transform(masked, lambda w: leaf(w, depth, min_words)).alias("leaves"), *exact)


def drop_templates(docs: DataFrame, depth: int = DEPTH, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, short_docs: int | None = None,
                   literal_docs: int | None = None, literal_words: int = LITERAL_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, text without the dropped lines, n_lines, n_dropped for every row.

    A template met in ``min_docs`` documents or more is dropped but for its first document. Lines under ``min_words`` words stay, unless
    ``short_docs`` is given: met word for word in so many documents, they are dropped likewise. With ``literal_docs`` this holds for
    lines of ``literal_words`` words or more too. Blank lines stay.
    NULL text becomes the empty text (one empty line). Repeated rows count as documents of their own; those of the smallest doc_id all
    keep their lines. Rows without doc_id come last in that order. Empty tables give no rows; other columns are not read."""
    exact = short_docs is not None or literal_docs is not None
    tree = stored(templates(docs, depth, min_words, literal_words if exact else None), "line-templates")

    def repeated(leaves: str, least: Column) -> DataFrame:
        once = tree.select("doc_id", F.explode(F.array_distinct(leaves)).alias("leaf")).where("leaf IS NOT NULL")
        recurring = (once.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first")).where(F.col("n_docs") >= least)
                     .select("leaf", "first"))
        met = tree.select("doc_id", "key", F.posexplode(leaves).alias("at", "leaf")).where("leaf IS NOT NULL").join(recurring, "leaf")
        return met.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("key", "at")

    places = repeated("leaves", F.lit(min_docs))
    if exact:
        places = places.union(repeated("exact", F.when(F.col("leaf") % 2 != 0, F.lit(short_docs)).otherwise(F.lit(literal_docs))))
    # the lines of one document, bounded by its text; repeated rows name the same places
    gone = places.groupBy("key").agg(F.collect_set("at").alias("gone"))
    split = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), lines(F.col("text")).alias("all")).join(gone, "key", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = split.withColumn("places", places)
    return kept.select("doc_id", F.array_join(F.transform("places", lambda i: F.col("all")[i]), "\n").alias("text"),
                       F.size("all").cast("long").alias("n_lines"), (F.size("all") - F.size("places")).cast("long").alias("n_dropped"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w, line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
t AS (SELECT doc_id, i, line, len(w) AS n, CASE WHEN len(w) <= 16 THEN w[1:8] ELSE w END AS leaf FROM l),
r AS (SELECT n, leaf, min(doc_id) AS first FROM t WHERE n >= 4 GROUP BY n, leaf HAVING count(DISTINCT doc_id) >= 5),
k AS (SELECT t.doc_id, t.i, t.line, r.first IS NOT NULL AND r.first <> t.doc_id AS gone FROM t LEFT JOIN r USING (n, leaf))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM k GROUP BY doc_id
"""


@query("op2_line_templates", SQL)
def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_templates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL_WHOLE = r"""
WITH l AS (
  SELECT doc_id, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w, line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
t AS (SELECT doc_id, i, line, raw, len(w) AS n, CASE WHEN len(w) <= 16 THEN w[1:8] ELSE w END AS leaf FROM l),
r AS (SELECT n, leaf, min(doc_id) AS first FROM t WHERE n >= 4 GROUP BY n, leaf HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT raw, min(doc_id) AS first FROM t WHERE n BETWEEN 1 AND 3 OR n >= 10 GROUP BY raw HAVING count(DISTINCT doc_id) >= CASE WHEN len(raw) <= 3 THEN 5 ELSE 2 END),
k AS (SELECT t.doc_id, t.i, t.line, coalesce(r.first <> t.doc_id, false) OR coalesce(x.first <> t.doc_id, false) AS gone FROM t LEFT JOIN r USING (n, leaf) LEFT JOIN x USING (raw))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM k GROUP BY doc_id
"""


@query("op2_line_templates_whole", SQL_WHOLE)
def op2_line_templates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With short lines and long literal lines too, each from a document count of its own."""
    rows = drop_templates(read(spark, sf_dir, "documents"), short_docs=SHORT_DOCS, literal_docs=LITERAL_DOCS)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
