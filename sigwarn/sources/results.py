"""Result tables with summary rows as CSV, and feature tables that are completed instead of written anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = ("MEAN", "STD")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='sigwarn-')).rstrip('/')}/sigwarn/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows reads it instead of working it out again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_summary(table: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The metrics of each key, and rows MEAN and STD (sample deviation) rounded to four places."""
    rows = table.select(F.col(key).cast("string").alias(key), *metrics)
    whole = rows.agg(*[F.struct(F.round(F.avg(x), 4).alias("MEAN"), F.round(F.stddev_samp(x), 4).alias("STD")).alias(x) for x in metrics])
    extra = whole.select(F.inline(F.array(*[F.struct(F.lit(s).alias(key), *[F.col(f"{x}.{s}").alias(x) for x in metrics]) for s in SUMMARY])))
    return rows.unionByName(extra)


def write_table(table: DataFrame) -> str:
    path = fresh_path(table.sparkSession, "results")
    table.write.option("header", True).csv(path)
    return path


def read_table(spark: SparkSession, path: str, key: str, metrics: list[str], aliases: tuple[str, ...] = ("patient", "patient_id", "subject")) -> DataFrame:
    """The rows of a result table without summary rows; its key column may go by another name."""
    raw = spark.read.option("header", True).csv(path)
    named = next(c for c in (key, *aliases) if c in raw.columns)
    return raw.where(~F.col(named).isin(*SUMMARY)).select(F.col(named).alias(key), *[F.col(x).cast("double").alias(x) for x in metrics])


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Adds the rows of keys that the table at `path` lacks; what is there stays, so a broken-off run is resumed."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.parquet(path).select(F.col(key).alias("_done")).distinct()
        df = df.join(done, F.col(key) == F.col("_done"), "left_anti")
    df.repartition(key).write.mode("append").partitionBy(key).parquet(path)
