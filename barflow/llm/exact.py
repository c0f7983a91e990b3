"""Exact deduplication by a keyed stream without expiry.

Arrivals (digest, document id, locator) run through a Structured Streaming aggregation whose state lives on the executors' disks
(RocksDB) and whose checkpoints and output lie in the shared folder. For each digest the state keeps the stable identifier (the
smallest id), where its content is, and the number of arrivals. Hits are then compared byte by byte with the content of the
row that stays, so a digest that two texts share does no harm. Everything runs as DataFrame operations in the JVM."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import SPACE_RUN, fresh_path, query, read, stored, unused

ARRIVAL = "digest string, doc_id {id}, locator string"


def normalised(text: Column) -> Column:
    """White-space runs as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def keyed_state(spark: SparkSession, arrivals: str, id_type: str, state: str) -> DataFrame:
    """Feed what is new in the folder ``arrivals`` to the stream kept in ``state`` (a shared path) and return the ledger: digest,
    keep_id, locator, group_size. Calling it again with the same ``state`` goes on where the last call ended; a batch that is
    replayed after a failure overwrites its own output. The caller's session settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")     # no reserved disk for many small stores
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    kept = (own.readStream.schema(ARRIVAL.format(id=id_type)).parquet(arrivals)
            .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min_by("locator", "doc_id").alias("locator"),
                                   F.count(F.lit(1)).alias("group_size")))
    ledger = f"{state}/ledger"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")

    (kept.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True)
     .foreachBatch(put).start().awaitTermination())
    rows = spark.read.schema(f"digest string, keep_id {id_type}, locator string, group_size long, batch int").parquet(ledger)
    return rows.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("now")).select("digest", "now.*")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the row with the smallest doc_id stays. NULL text counts as empty. Rows
    without doc_id never become keep_id unless a group has no other; repeated rows with one doc_id all name that id and are all
    ``kept`` (``deduplicated`` leaves one of them). Empty tables give no rows; other columns are not read. ``state``: shared path of
    a stream to continue (the documents are then judged together with those seen before, whose texts are kept there for the comparison); a new
    one, without texts, by default."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    kept_open = state is not None
    state = state or fresh_path(spark, "dedup")
    bodies = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("digest", digest(F.col("body")))
    if kept_open:       # later calls must be able to read what this one has seen: their hits are compared with it
        call = f"{state}/content/{uuid.uuid4().hex}"
        bodies.write.parquet(call)
        bodies = spark.read.schema(bodies.schema).parquet(call)
        located = bodies.select("digest", "doc_id", F.lit(call).alias("locator"))
    else:
        located = docs.select(digest(normalised(F.col("text"))).alias("digest"), "doc_id", F.input_file_name().alias("locator"))
    arrivals = f"{state}/arrivals"
    located.write.mode("append").parquet(arrivals)
    ledger = keyed_state(spark, arrivals, id_type, state)
    met = bodies.join(ledger, "digest")
    # hits: full bytes against the content of the row that stays (singletons need no second look); both sides share one shuffle
    first = (met.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1))
             .groupBy("digest").agg(F.min("body").alias("first_body")))
    if kept_open:       # a row that stays from an earlier call lies where its locator says
        hits = met.where(F.col("locator") != call).select("digest", "keep_id", "locator").distinct()
        first = first.unionByName(fetched(spark, stored(hits, "dedup-hits"), bodies.schema)).groupBy("digest").agg(F.min("first_body").alias("first_body"))
    checked = (met.join(first, "digest", "left")
               .select("doc_id", "digest", "keep_id", "group_size", sha256(F.col("body")).alias("text_sha256"),
                       F.when(F.col("first_body") != F.col("body"), F.sha2(F.col("body"), 512)).alias("other")))
    seen = stored(checked, "dedup-checked")
    # texts that only share a digest are taken out and grouped by their own content
    odd = seen.where("other IS NOT NULL")
    if kept_open:       # with all that earlier calls have brought under the same digest
        every = spark.read.schema(bodies.schema).parquet(f"{state}/content/*").join(odd.select("digest").distinct(), "digest", "left_semi")
        kin = every.groupBy("digest", F.sha2("body", 512).alias("other")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        at = ledger.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k"))
        heads = (every.join(at, (every["digest"] == at["_d"]) & every["doc_id"].eqNullSafe(at["_k"]), "left_semi")
                 .select("digest", "body").groupBy("digest").agg(F.sha2(F.min("body"), 512).alias("own")))
        regrouped = kin.join(heads, "digest").where("other <> own").drop("own")
        lost = regrouped.groupBy("digest").agg(F.sum("group_size").alias("n_other"))
    else:
        regrouped = odd.groupBy("digest", "other").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        lost = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("n_other"))
    same = (seen.where("other IS NULL").join(lost, "digest", "left")
            .withColumn("group_size", F.col("group_size") - F.coalesce("n_other", F.lit(0))))
    moved = odd.drop("keep_id", "group_size").join(regrouped, ["digest", "other"])
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return same.select(*cols).unionByName(moved.select(*cols))


def fetched(spark: SparkSession, hits: DataFrame, schema: T.StructType) -> DataFrame:
    """Bodies of the rows that ``hits`` (digest, keep_id, locator) name: digest, first_body. Only the folders they lie in are read, one per earlier call."""
    folders = [r.locator for r in hits.select("locator").distinct().collect()]
    if not folders:
        return spark.createDataFrame([], T.StructType([T.StructField("digest", T.StringType()), T.StructField("first_body", T.StringType())]))
    there = spark.read.schema(schema).parquet(*folders)
    wanted = hits.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k"))
    return (there.join(wanted, (there["digest"] == wanted["_d"]) & there["doc_id"].eqNullSafe(wanted["_k"]))
            .groupBy("digest").agg(F.min("body").alias("first_body")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of repeated rows (same doc_id and text) one."""
    key = unused(docs, "_key")
    verdict = dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    keyed = docs.withColumn(key, sha256(normalised(F.col("text"))))
    kept = keyed.join(verdict, keyed["doc_id"].eqNullSafe(verdict["_id"]) & (keyed[key] == verdict["_sha"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM n JOIN g USING (body)
"""


@query("op4_exact_dedup", SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
