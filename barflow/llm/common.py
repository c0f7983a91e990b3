"""Column helpers, tables in the shared folder, and the registry of the subpackage's queries."""
from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.session import shared_dir

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# The six ASCII white-space characters that part words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array: runs without ASCII white space; none for NULL or blank text."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, for a helper column beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def slices(column: pa.Array, size: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Stretches of the texts (or binaries) of an Arrow column of about ``size`` bytes and at most ``rows`` rows together; a longer text
    stands alone."""
    a = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > a and (total + n > size or i - a == rows):
            yield a, i
            a, total = i, 0
        total += n
    if a < len(column):
        yield a, len(column)


def tidy(run: Callable) -> Callable:
    """``run`` over Arrow batches, after which the worker gives back the memory it no longer uses: idle workers stay beside the next stages."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):       # another C library
            pass
    return wrapped


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: the lineage is cut, and lost executors cost no more than
    the tasks they ran."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
