"""Intermediate tables that survive lost executors: Parquet in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import inspect
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of kept_rows(): at most so many numbers go to the executors.
SLOTS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a local[...] session without the setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="sigwarn-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sigwarn/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sigwarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_sigwarn_path", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_of_any_name(*results: str, param: str = "id_col") -> Callable:
    """For operators that return an id column beside `results`: where the id is named like one, that one gets a trailing underscore."""

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(*args, **named) -> DataFrame:
            given = signature.bind(*args, **named)
            given.apply_defaults()
            name, table = given.arguments[param], next(iter(given.arguments))
            if name.lower() in results:
                df = given.arguments[table]
                (inner,) = fresh(df, "_row_id")
                given.arguments[table], given.arguments[param] = df.withColumnRenamed(name, inner), inner
                out = operator(*given.args, **given.kwargs)
                return out.toDF(*[name if c == inner else c + "_" * (c.lower() == name.lower()) for c in out.columns])
            return operator(*given.args, **given.kwargs)

        return run

    return around


def kept_rows(docs: DataFrame, verdict: DataFrame, id_col: str, same: Column) -> DataFrame:
    """The rows of docs without those that verdict(_id, _kept) names as going; of rows it names as kept, one for each `same`.

    With a column _same, a row of the verdict holds for the rows of docs with that value of `same` only. The verdict
    has rows only for what changes: rows that go, and rows that repeat each other. Texts mostly stay where they are:
    ids of the verdict are dealt to SLOTS slots, the taken slots are broadcast (that is their bound, whatever the
    verdict's size), and only documents in such a slot are shuffled to meet the verdict.
    """
    slot, own, taken, gone_id, gone_same, stays = fresh(docs, "_slot", "_own", "_taken", "_gone_id", "_gone_same", "_stays")
    slot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    by_text = "_same" in verdict.columns
    verdict = verdict.select(F.col("_id").alias(gone_id), F.col("_kept").alias(stays), *[F.col("_same").alias(gone_same)] * by_text)
    slots = materialize(verdict.select(slot_of(F.col(gone_id)).alias(taken)).distinct())
    dealt, met = docs.withColumn(slot, slot_of(F.col(id_col))), F.col(slot) == F.col(taken)
    untouched = dealt.join(F.broadcast(slots), met, "left_anti").drop(slot)
    touched = dealt.join(F.broadcast(slots), met, "left_semi").withColumn(own, same)
    named = F.col(id_col).eqNullSafe(F.col(gone_id))
    if by_text:
        named &= F.col(own).eqNullSafe(F.col(gone_same))
    out = untouched.unionByName(touched.join(verdict, named, "left_anti").drop(slot, own))
    again = verdict.where(stays)
    if again.isEmpty():
        return out
    return out.unionByName(touched.join(again, named, "left_semi").dropDuplicates([id_col, own]).drop(slot, own))
