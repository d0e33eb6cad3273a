"""Order-dependent counters as windows: streaks, resets and what happens between two events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def streaks(df: DataFrame, by: Sequence[str], order: str, hit: Column, name: str = "streak") -> DataFrame:
    """Adds how many hits in a row end at each row; 0 where there is none."""
    w = W.partitionBy(*by).orderBy(order)
    df = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    df = df.withColumn("__isle", F.sum((~F.col("__hit")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*by, "__isle").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col("__hit").cast("int")).over(inside).cast("bigint")).drop("__hit", "__isle")


def unchanged(df: DataFrame, by: Sequence[str], order: str, state: str, name: str = "unchanged") -> DataFrame:
    """Adds how often in a row a state came back unchanged."""
    same = F.col(state).eqNullSafe(F.lag(state).over(W.partitionBy(*by).orderBy(order))) & F.lag(F.lit(1)).over(W.partitionBy(*by).orderBy(order)).isNotNull()
    return streaks(df.withColumn("__same", same), by, order, F.col("__same"), name).drop("__same")


def between(df: DataFrame, by: Sequence[str], order: str, reset: Column, end: Column, count: Column) -> DataFrame:
    """For each reset that an end follows before the next reset: *by, `epoch`, `n`, the counted rows in between."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("epoch", F.sum(reset.cast("int")).over(w).cast("bigint")).filter("epoch > 0")
    df = df.withColumn("__end", F.min(F.when(end, F.col(order))).over(W.partitionBy(*by, "epoch")))
    got = df.filter(F.col("__end").isNotNull() & (F.col(order) <= F.col("__end")))
    return got.groupBy(*by, "epoch").agg(F.count_if(count & (F.col(order) < F.col("__end"))).alias("n"))


def running_count(df: DataFrame, by: Sequence[str], order: str, what: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(what.cast("int")).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))


def stages(df: DataFrame, by: Sequence[str], order: str, feedback: Column, rounds: Column) -> DataFrame:
    """Adds `stage` by what came before a row: `first`, `self_rescue` after feedback, `oracle_k` after k rounds."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen, told = (F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0)) for c in (feedback, rounds))
    return df.withColumn("stage", F.when(told > 0, F.concat(F.lit("oracle_"), told.cast("string"))).when(seen > 0, "self_rescue").otherwise("first"))
