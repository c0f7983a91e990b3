"""Quality rules as a ledger of bits.

Every rule is evaluated once per document: the ledger keeps its measurements and one bit per failed rule. Policies are masks with a
version; applying one, or asking what a rule alone costs, is bit arithmetic on the ledger and never reads a text again."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import NON_SPACE, SPACES, query, read, words

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (name, failing condition over the measurements); a rule's bit is its place in this list, so rules are only ever appended.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "n_upper >= 200 AND 2 * n_upper > word_chars"),
]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        at = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum(at[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
DEFAULT = Policy("web-1", tuple(name for name, _ in RULES))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the measurements; every array lives in one row, bounded by its own text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*carried, text.alias("_t"), words(F.col("text")).alias("_w"),
                    F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE)).alias("_l"))
    w, n = F.col("_w"), F.size("_w")
    b = a.select(
        *carried, n.cast("long").alias("n_words"),
        (F.length("_t") - _without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        _without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"), _without(F.col("_t"), _UPPER).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
        .otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # windows met twice or more: equal neighbours once (hash, place) pairs are sorted; most texts have none and skip the sort
    h = F.col("_h")
    c = b.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h),
                                  F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_h")
    s = F.col("_s")
    met = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    d = c.withColumn("_p", F.sort_array(F.transform(met, lambda x: x["i"]))).drop("_s")
    p = F.col("_p")
    # each window covers three words; where the next one starts earlier, only those before it count here
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    n_repeat = F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")
    # a filter pushed below these projections would evaluate the word array once per word: a column that the optimizer takes for
    # non-deterministic keeps filters above them
    return d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, n_repeat)).drop("_p")


def ledger(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, measurements, ``fail_bits``.

    NULL and blank texts have no words: all measurements are 0 and few_words fails. Repeated rows give repeated rows, empty tables
    none; other columns, whatever their names, are not read. Texts of any length are measured whole."""
    bits = [F.when(F.expr(cond), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, cond) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measured(docs, carried).withColumn("fail_bits", out)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``policy`` (its version) and ``passed`` to a ledger."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("passed", F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablation(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """What each rule of each policy costs: policy, rule, n_failed, n_only (failed by this rule alone: kept if it were dropped),
    n_passed, and of the policy's failures the bits that all or any of them share. The ledger is reduced to its distinct bit
    patterns first (at most 2^rules rows); everything after that is bitwise aggregation."""
    spark = rows.sparkSession
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame([(p.version, p.mask, r, Policy("", (r,)).mask) for p in policies for r in p.rules],
                                  "policy string, mask long, rule string, bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    at = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return (patterns.join(F.broadcast(asked))      # a handful of rules against a handful of patterns
            .groupBy("policy", "rule").agg(at(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), at(hit == F.col("bit")).alias("n_only"),
                                           at(hit == 0).alias("n_passed"), F.bit_and(F.when(hit != 0, hit)).alias("bits_all"), F.bit_or(hit).alias("bits_any")))


def rated(docs: DataFrame, policy: Policy = DEFAULT, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the ledger, ``base_failed`` and ``kept`` (false if a base rule fails, else the policy's verdict)."""
    rows = apply_policy(ledger(docs, carried), policy)
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & F.col("passed")).drop("passed")


def passing(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were; no shuffle."""
    return rated(docs.select("text", F.struct("*").alias("_row")), policy, ("_row",)).where("kept").select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
f AS (
  SELECT m.doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_upper::BIGINT AS n_upper,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN n_upper >= 200 AND 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM f)
SELECT *, 'web-1' AS policy, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept FROM b
"""


@query("op1_quality_rules", SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(read(spark, sf_dir, "documents"))
