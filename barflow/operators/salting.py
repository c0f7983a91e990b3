"""Joins of a large table with one row per key, safe for a hot key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def salt(df: DataFrame, spread: list[str]) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))


def every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where ``small`` has one row per key.

    A plain join would leave the rows hashed by key, and a window or aggregate after it would reuse that layout, so
    adaptive execution could not split a hot key.  Here the rows of a key spread over SALTS tasks by a hash of
    ``spread`` and ``small`` is repeated SALTS times.  A small enough side is still broadcast at run time."""
    return salt(big, spread).join(every_salt(small), [*keys, "_salt"], how).drop("_salt")
