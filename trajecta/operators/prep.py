"""Filter chains with counted reasons, deduplication, caps and seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions.hashing import hash_order


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, null where none does; null conditions don't hold."""
    out = F.when(F.lit(False), F.lit(""))
    for name, cond in reasons:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out


def content_print(*columns: str) -> Column:
    """SHA-1 over the columns' texts, separated by a character that texts don't hold; nulls count as empty."""
    return F.sha1(F.concat_ws("\u001f", *[F.coalesce(F.col(c), F.lit("")) for c in columns]).cast("binary"))


def mark_repeats(df: DataFrame, key: Column, order: str, among: Column, name: str = "repeat") -> DataFrame:
    """Adds whether an earlier row among the given ones has the same key.

    The first row of each key comes from a partial aggregate that is joined back, so that a hot key is no hot task.
    """
    keyed = df.withColumn("__key", F.when(among, key))
    first = keyed.filter("__key is not null").groupBy("__key").agg(F.min(order).alias("__first"))
    out = keyed.join(first, "__key", "left")
    return out.withColumn(name, F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__key", "__first")


def drop_chain(df: DataFrame, order: str, early: Sequence[tuple[str, Column]], key: Column, late: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with `reason`: early conditions, then `dup` among their survivors, then late conditions; null for what stays.

    A row is counted under the first condition that it meets, and a row that a late condition drops has claimed its key.
    Late conditions are evaluated before the join on the key, so that texts they look at needn't move with it.
    """
    df = df.withColumn("__early", first_reason(early)).withColumn("__late", first_reason(late))
    df = mark_repeats(df, key, order, F.col("__early").isNull(), "__dup")
    return df.withColumn("reason", F.coalesce(F.col("__early"), F.when(F.col("__dup"), "dup"), F.col("__late"))).drop("__early", "__late", "__dup")


def capped(df: DataFrame, key: str, n: int, seed: str, row: str, first: Sequence[Column] = ()) -> DataFrame:
    """At most n rows of each key: those of `first` before others, then in seeded order.

    The cap is a window group limit: map tasks send n rows of a key at most.
    """
    w = W.partitionBy(key).orderBy(*first, hash_order(seed, F.col(row)), F.col(row))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def shuffled(df: DataFrame, seed: str, row: str) -> DataFrame:
    """All rows in a seeded order that any partitioning repeats."""
    return df.orderBy(hash_order(seed, F.col(row)), F.col(row))


def shares(df: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Counts by columns with their share of all rows; the window sees only the counts."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), digits))


def accounting(df: DataFrame, reason: str = "reason") -> DataFrame:
    """How many rows were read, kept and dropped under each reason."""
    kept = F.coalesce(F.col(reason), F.lit("kept"))
    return df.groupBy(kept.alias("reason")).agg(F.count("*").alias("n")).unionByName(df.agg(F.count("*").alias("n")).select(F.lit("read").alias("reason"), "n"))


def gate(n: int, least: int) -> tuple[bool, str]:
    """Whether enough is kept to train, and a line that says so."""
    return n >= least, f"{'GO' if n >= least else 'NO-GO'}: {n} kept, {least} needed"


def new_work(work: DataFrame, done: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """At most so many rows of work that isn't done, in the given order: the limit counts new work only."""
    return work.join(done.select(key).distinct(), key, "left_anti").orderBy(*order, key).limit(most)


def worst(df: DataFrame, score: Column, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest score (a top-k report), nulls last, ties by the given columns."""
    return df.orderBy(score.desc_nulls_last(), *ties).limit(n)


def progress(df: DataFrame, by: str, order: Sequence[str], failed: Column) -> DataFrame:
    """df with `done` and `failed`: how many rows of their group had ended with each row, and how many of them had failed."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("done", F.count("*").over(w)).withColumn("failed", F.sum(F.coalesce(failed, F.lit(False)).cast("bigint")).over(w))


def protocol_tag(source: Column, protocol: Column, leaking: Sequence[str]) -> Column:
    """A sample's protocol: `raw_leak` stays only where its source is one that such feedback reaches; elsewhere it is `none`."""
    return F.when((protocol == "raw_leak") & ~F.coalesce(source.isin(*leaking), F.lit(False)), "none").otherwise(protocol)


def registry(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, `entry`): each key's set of members, sorted, as one JSON object."""
    sets = df.filter(F.col(key).isNotNull() & F.col(member).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(member))
    return sets.select(key, F.to_json(F.struct(key, member)).alias("entry"))
