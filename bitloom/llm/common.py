"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and everything runs on one machine (tests), it is set to a new temporary folder; on a cluster
    that would be a folder which the others cannot see, so there it has to be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, which cuts its lineage and outlives executors.

    The shuffle files of the write are of no use to anyone after it; for its time Spark is told to delete them at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that no plan reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("table-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def is_training(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is not 2; a null id is held out of training as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most so many rows at once to Python, so that long texts stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def bounded_sample(rows: DataFrame, group: str, bound: int, key: str = "doc_id") -> DataFrame:
    """About bound rows of each value of group at most, chosen by the key's hash: the same rows on every run.

    Every row of a group has the same chance, bound / rows of the group; the counts cover all rows.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, bound / n))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share[F.col(group)])
