"""Writers: partitioned outputs, refreshes, resumable appends and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.hashing import hash_order


def fan_out(df: DataFrame, path: str, *by: str) -> None:
    """One folder for each value, JSON lines inside, in one pass."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def refresh(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that df has; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def chat_rows(df: DataFrame, user: str, answer: str, keep: list[str]) -> DataFrame:
    """Conversations of a human and a model turn, with columns to keep."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return df.select(F.array(turn("human", user), turn("gpt", answer)).alias("conversations"), *keep)


def ranking_rows(df: DataFrame, prompt: str, chosen: str, rejected: str, keep: list[str]) -> DataFrame:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return df.select(F.array(turn("human", prompt)).alias("conversations"), turn("gpt", chosen).alias("chosen"), turn("gpt", rejected).alias("rejected"), *keep)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> int:
    """Appends the rows whose key isn't stored, one of each key; gives their number. A repeated call appends nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.format(fmt).load(path).select(key).distinct(), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").format(fmt).save(path)
    fresh.unpersist()
    return n


def report(df: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON document a line."""
    df.coalesce(1).write.mode("overwrite").json(path)


def rewritten(df: DataFrame, changes: dict[str, Callable]) -> DataFrame:
    """Columns rewritten, with `changed`, the number of fields that differ afterwards; nothing is changed in place."""
    out, n = df, F.lit(0)
    for c, f in changes.items():
        out = out.withColumn(f"__{c}", f(F.col(c)))
        n = n + (~F.col(c).eqNullSafe(F.col(f"__{c}"))).cast("int")
    out = out.withColumn("changed", n)
    for c in changes:
        out = out.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    return out


def sampled_text(df: DataFrame, path: str, text: str, row: str, n: int, seed: str) -> None:
    """n rows in seeded order as text, for reading."""
    df.orderBy(hash_order(seed, F.col(row))).limit(n).select(F.col(text).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def poison(spark: SparkSession, path: str, ids: DataFrame, key: str) -> None:
    """A list of keys to skip: the stored ones and new ones, each once, in order.

    The new list is written beside the old one and takes its name only when it is complete, so that a lost executor or
    a broken run leaves one of the two whole; what a broken run left beside is picked up by the next.
    """
    fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    ids = ids.select(key)
    for stored in (path, old):
        if fs.exists(fs_path(stored)):
            ids = ids.union(spark.read.schema(f"{key} {dict(ids.dtypes)[key]}").json(stored))
    ids.distinct().orderBy(key).write.mode("overwrite").json(fresh)
    if fs.exists(fs_path(path)):
        fs.delete(fs_path(old), True)
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(fresh), fs_path(path))
    fs.delete(fs_path(old), True)


def mark_done(spark: SparkSession, path: str, ids: DataFrame, key: str, version: str) -> None:
    """Notes keys as done under a version; what failed isn't noted and will be tried again."""
    ids.select(key).distinct().withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
