"""Shared pieces of the training-data operators: tables, scratch tables, fixed hashes and token ids.

Every scratch table goes to the folder that the cluster names in `spark.checkpoint.dir`, so a lost
executor takes nothing with it that only its own disk holds. Where that setting is absent, only a
session on one machine (`local`) gets a temporary folder in its place; on a cluster that is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import session


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches to 1,000 rows and 64 MB, since single texts can be very long."""
    session.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table through Spark's reader, whatever the store."""
    prepare(spark)
    return session.table(spark, sf_dir, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage is cut, and later
    stages read columns instead of computing them again."""
    path = f"{session.shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`: the fold of a document."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per key with a non-null label; of repeated rows the smallest label counts."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The `bound` rows whose hashed key is smallest: a fixed, evenly spread sample."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(bound)
