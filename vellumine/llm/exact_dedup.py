"""Exact deduplication by a stateful stream.

Documents are reduced to (digest, identifier, locator) records.  A structured stream folds
the records into keyed state on disk (RocksDB, checkpointed in the shared folder) that never
expires: for each digest the number of records, the largest identifier and that record's
content locator.  Restarting with the same state folder continues where it stopped.
Digests that occur more than once are hits; their full bytes are compared with the bytes of
the retained document, so that a digest collision can never merge different texts.

Edge cases: a null text counts as the empty text; a null identifier sorts below all others;
rows that repeat both identifier and text form one group of which exactly one row is kept;
an empty table gives an empty result; all columns of the input are passed on, but those named
like a column of the result give way to it; internal columns carry the prefix ``__x_``.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_root, small_or_shuffled

#: Bytes of record files that one micro-batch folds.
BYTES_PER_BATCH = 64 << 30
#: Settings under which the state lives on disk instead of in the executors' heaps.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no file space is reserved ahead of what is written
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fold_records(spark: SparkSession, inbox: str, home: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Fold all new record files of ``inbox`` into the state under ``home``.

    Records are (digest binary, id bigint, locator string).  Returns the whole state: one row
    per digest with ``n``, ``keep_id`` and ``locator``.  May be called again after more files
    have come; only those are read then.
    """
    schema = "digest binary, id bigint, locator string"
    records = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(inbox)
    state = records.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "locator")).alias("best")
    )
    changes = f"{home}/changes"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    with _settings(spark, STATE_CONF):
        run = (
            state.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{home}/state")
            .foreachBatch(keep)
            .start()
        )
        run.awaitTermination()
    out = "digest binary, n bigint, best struct<id: bigint, locator: string>, batch bigint"
    try:
        seen = spark.read.schema(out).option("basePath", changes).parquet(changes)
    except Exception as error:  # no batch ever ran: the inbox holds no records
        if "PATH_NOT_FOUND" not in str(error):
            raise
        seen = spark.createDataFrame([], out)
    return seen.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select(
        "digest", F.col("s.n").alias("n"), F.col("s.best.id").alias("keep_id"), F.col("s.best.locator").alias("locator")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept, text_sha256 and keep_locator."""
    spark = docs.sparkSession
    home = shared_root(spark)
    # one sha256 pass; the digest is the key of the state
    keyed = docs.withColumns(
        {
            "__x_text": F.coalesce(F.col(text_col).cast("string"), F.lit("")),
            "__x_file": F.input_file_name(),
        }
    ).withColumn("__x_digest", F.unhex(F.sha2("__x_text", 256)))
    keyed.select(
        F.col("__x_digest").alias("digest"), F.col(id_col).cast("bigint").alias("id"), F.col("__x_file").alias("locator")
    ).write.parquet(f"{home}/inbox")
    state = fold_records(spark, f"{home}/inbox", home, bytes_per_batch)
    hits = materialise(
        state.where("n > 1").select(
            F.col("digest").alias("__x_digest"), F.col("keep_id").alias("__x_keep"), F.col("locator").alias("__x_locator")
        ),
        f"{home}/hits",
    )
    hits = small_or_shuffled(hits)
    single = keyed.join(hits.select("__x_digest"), "__x_digest", "left_anti").select(
        *docs.columns,
        F.col(id_col).cast("bigint").alias("__x_keep_id"),
        F.lit(1).cast("bigint").alias("__x_size"),
        F.lit(True).alias("__x_kept"),
        F.lower(F.hex("__x_digest")).alias("__x_sha"),
        F.col("__x_file").alias("__x_at"),
    )
    copies = keyed.join(hits, "__x_digest")
    # the retained content, found by identifier and locator, against which bytes are compared
    # (written out, as a join under which an aggregate stands can't split a hot digest)
    retained = (
        copies.where(F.col(id_col).cast("bigint").eqNullSafe(F.col("__x_keep")) & (F.col("__x_file") == F.col("__x_locator")))
        .groupBy("__x_digest")
        .agg(F.max("__x_text").alias("__x_content"))
    )
    retained = materialise(retained, f"{home}/retained")
    checked = copies.join(retained, "__x_digest", "left").withColumn(
        "__x_other", F.when(F.col("__x_text") == F.col("__x_content"), F.lit("")).otherwise(F.concat(F.lit("="), "__x_text"))
    )
    checked = checked.drop("__x_text", "__x_content", "__x_keep", "__x_locator").withColumn(
        "__x_row", F.monotonically_increasing_id()
    )
    checked = materialise(checked, f"{home}/checked")
    groups = checked.groupBy("__x_digest", "__x_other").agg(
        F.count(F.lit(1)).alias("__x_size"),
        F.max(F.struct(F.col(id_col).cast("bigint").alias("id"), F.col("__x_row").alias("row"), F.col("__x_file").alias("at"))).alias("__x_best"),
    )
    groups = materialise(groups, f"{home}/groups")
    many = checked.join(groups, ["__x_digest", "__x_other"]).select(
        *docs.columns,
        F.col("__x_best.id").alias("__x_keep_id"),
        "__x_size",
        (F.col("__x_row") == F.col("__x_best.row")).alias("__x_kept"),
        F.lower(F.hex("__x_digest")).alias("__x_sha"),
        F.col("__x_best.at").alias("__x_at"),
    )
    named = {"keep_id": "__x_keep_id", "group_size": "__x_size", "kept": "__x_kept", "text_sha256": "__x_sha", "keep_locator": "__x_at"}
    return single.unionByName(many).select(
        *(c for c in docs.columns if c not in named), *(F.col(v).alias(k) for k, v in named.items())
    )
