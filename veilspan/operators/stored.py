"""Rows merged into stored tables exactly once: append, insert-or-ignore, replace, and events applied to a table.

A stored table is a folder of Parquet files with a partition for each batch. A batch writes its own partition and
looks at the others only, so a batch that is delivered or run again writes what it wrote before: nothing changes.
Streams merge through `ingest`, whose batches Spark numbers and repeats after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, with the batch of each row; empty where nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, {BATCH} long")
    return spark.read.schema(f"{schema}, {BATCH} long").parquet(path)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)


def insert_or_ignore(rows: DataFrame, path: str, keys: list[str], batch: int, order: list[str] | None = None) -> None:
    """Store the rows whose keys no other batch has stored; of several rows of one key in this batch the first by `order`.
    Rows with a null in a key are stored as they are met once for each such key."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("place_")
    else:
        rows = rows.dropDuplicates(keys)
    held = stored(rows.sparkSession, path, _schema(rows)).where(F.col(BATCH) != batch)
    unheld(rows, held, keys).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def unheld(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (nulls are equal) no held row has. Held keys grow with the table and are never broadcast, however
    small their files are."""
    own = held.select(*[F.col(k).alias(f"held_{k}") for k in keys])
    return rows.join(own.hint("merge"), [F.col(k).eqNullSafe(F.col(f"held_{k}")) for k in keys], "left_anti")


def replace_of(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of a table (partitioned by `by`) that the rows belong to, and no others. A job that fails
    leaves the old partitions."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def validated(records: DataFrame, required: list[str], origin: str) -> DataFrame:
    """Records with `refused`: why one is not taken (a required field is missing, or who forwarded it), else null."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required])
    unattributed = F.col(origin).isNull() | (F.col(origin) == "")
    return records.withColumn("refused", F.when(missing != "", F.concat(F.lit("malformed: "), missing)).when(unattributed, "no origin"))


def ingest(records: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str] | None = None, **trigger) -> StreamingQuery:
    """A stream of records into a stored table: each key once, by its first batch."""

    def store(rows: DataFrame, batch: int) -> None:
        insert_or_ignore(rows, path, keys, batch, order)

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_key_events(keys: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """A table of keys (key_id, active, origin_gateway, ...) after key events (event_id, event_type, key_id, gateway_id).

    A `created` event adds a key that is not known, marked with who forwarded it; one that is known stays as it is.
    `revoked` ends a key that was known by then. An event counts once however often it was delivered; `at` orders events."""
    once = events.dropDuplicates(["event_id"]).withColumn("at_", at)
    born = once.where("event_type = 'created'").groupBy("key_id").agg(F.min("at_").alias("born"), F.min_by("gateway_id", "at_").alias("gateway"))
    known = keys.select("key_id", F.lit(True).alias("local")).join(born, "key_id", "full")
    ended = once.where("event_type = 'revoked'").join(known, "key_id").where("local or at_ > born").select("key_id").distinct().withColumn("ended", F.lit(True))
    merged = known.join(keys, "key_id", "left").join(ended, "key_id", "left")
    active = F.coalesce("active", F.lit(True)) & F.col("ended").isNull()
    origin = F.when(F.col("local").isNull(), F.col("gateway")).otherwise(F.col("origin_gateway"))
    return merged.withColumn("active", active).withColumn("origin_gateway", origin).select(*keys.columns)
