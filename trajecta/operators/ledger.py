"""Message logs to hypothesis cards: sessions cut by what is said, evidence assigned by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions import fixed
from trajecta.functions import text as T


def card_openings(log: DataFrame, by: Sequence[str], order: str = "idx", role: str = "role", text: str = "text", width: int = 400) -> DataFrame:
    """log with `hyp`, `feedback`, `opens`, `card` (0 before the first) and `opened_by`.

    A message opens a card if the assistant states a hypothesis (no placeholder) and it is another than the current
    card's, or feedback came since the last statement. `opened_by` is that feedback's kind (the last), else `explore`.
    All windows have one partitioning and order, so that Spark sorts once.
    """
    said = F.when((F.col(role) == "assistant") & ~F.contains(text, F.lit(fixed.PLACEHOLDER)), F.substring(F.regexp_extract(text, r"HYPOTHESIS:\s*(.+)", 1), 1, width))
    w = W.partitionBy(*by).orderBy(order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    df = log.withColumn("hyp", F.nullif(said, F.lit(""))).withColumn("feedback", F.when(F.col(role) != "assistant", T.trigger(text)))
    df = df.withColumn("__before", F.last("hyp", ignorenulls=True).over(past))
    # feedback counts if it came after the last statement
    df = df.withColumn("__fed", F.last(F.when(F.col("feedback").isNotNull(), F.struct(F.col(order).alias("at"), F.col("feedback").alias("kind"))), ignorenulls=True).over(past))
    df = df.withColumn("__said", F.last(F.when(F.col("hyp").isNotNull(), F.col(order)), ignorenulls=True).over(past))
    pending = F.when(F.col("__said").isNull() | (F.col("__fed")["at"] > F.col("__said")), F.col("__fed")["kind"])
    df = df.withColumn("opens", F.col("hyp").isNotNull() & (F.col("__before").isNull() | (F.col("hyp") != F.col("__before")) | pending.isNotNull()))
    df = df.withColumn("opened_by", F.when(F.col("opens"), F.coalesce(pending, F.lit("explore"))))
    df = df.withColumn("card", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
    return df.drop("__before", "__fed", "__said")


def cards(log: DataFrame, by: Sequence[str], order: str = "idx") -> DataFrame:
    """One row for each card: *by, `card`, `raw_ref`, `opened_by`, `hyp`."""
    return log.filter("opens").select(*by, "card", F.concat(F.lit("msg#"), F.col(order).cast("string")).alias("raw_ref"), "opened_by", "hyp")


def latest_by(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The value of the last row of each group; a partial aggregate, no window."""
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))


def latest_snapshots(df: DataFrame, by: Sequence[str], body: str, order: str, least: int = 40, width: int = 2500) -> DataFrame:
    """The last real snapshot of each group, cut to width: an error or an empty read, of `least` characters or fewer, replaces none."""
    real = df.withColumn(body, T.strip(body)).filter(F.length(body) > least)
    return latest_by(real.withColumn(body, F.substring(body, 1, width)), by, body, order)


def first_seen_top(df: DataFrame, by: Sequence[str], item: str, order: str, front: Column, n: int) -> DataFrame:
    """The first n distinct items of each group, those of `front` first, then by first appearance; with `place`."""
    seen = df.groupBy(*by, item).agg(F.min(order).alias("__at"), F.max(front.cast("int")).alias("__front"))
    w = W.partitionBy(*by).orderBy(F.col("__front").desc(), "__at", item)
    return seen.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("__at", "__front")


def pair_actions(messages: DataFrame, by: Sequence[str], order: str = "idx", role: str = "role", actions: str = "actions", text: str = "text") -> DataFrame:
    """The k-th action of an assistant message with the k-th observation behind it: *by, `block`, `k`, `action`, `observation`.

    A block is an assistant message and what follows up to the next one; an action without observation keeps null.
    """
    w = W.partitionBy(*by).orderBy(order)
    talk = (F.col(role) == "assistant").cast("int")
    df = messages.withColumn("block", F.sum(talk).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
    acts = df.filter(F.col(role) == "assistant").select(*by, "block", F.posexplode(actions).alias("k", "action"))
    seen = df.filter((F.col(role) != "assistant") & (F.col("block") > 0))
    seen = seen.select(*by, "block", (F.row_number().over(W.partitionBy(*by, "block").orderBy(order)) - 1).alias("k"), F.col(text).alias("observation"))
    return acts.join(seen, [*by, "block", "k"], "left")


def attach_results(events: DataFrame, by: Sequence[str], order: str, is_test: Column, result: Column, width: int = 400) -> DataFrame:
    """For each test of a group the first qualifying observation after it and before the next test: *by, `test_at`, `result`."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = events.withColumn("test_at", F.last(F.when(is_test, F.col(order)), ignorenulls=True).over(w)).withColumn("__r", F.when(~is_test, result))
    return df.filter("test_at is not null").groupBy(*by, "test_at").agg(F.min_by(F.substring("__r", 1, width), F.when(F.col("__r").isNotNull(), F.col(order))).alias("result"))


def last_before(nodes: DataFrame, items: DataFrame, by: Sequence[str], order: str, item: str, at: str, n: int, distinct: bool = True, name: str = "prior") -> DataFrame:
    """nodes with `name`: the last n items of their group that belong to an order value strictly before the node's.

    items has *by, order (the node that gathered it), at (its place there) and item. With `distinct` an item counts where
    it appears first. Evidence of a node itself and of later ones never shows, as a node's row sorts before its items.

    Every row carries n items at most and the frames run forward, so that a long log costs its length. nodes with the
    same order value in a group each get the same items.
    """
    rows = items.select(*by, F.col(order).alias("__order"), F.col(at).alias("__at"), F.col(item).alias("__item"))
    if distinct:
        first = rows.groupBy(*by, "__item").agg(F.min(F.struct("__order", "__at")).alias("__p"))
        rows = first.select(*by, F.col("__p.__order").alias("__order"), F.col("__p.__at").alias("__at"), "__item")
    w = W.partitionBy(*by).orderBy("__order", "__at", "__item")
    rows = rows.withColumn("__last", F.collect_list("__item").over(w.rowsBetween(-(n - 1), 0)))
    kept = nodes.select(*by, F.col(order).alias("__order"), F.struct(*[c for c in nodes.columns]).alias("__node"))
    both = kept.unionByName(rows.select(*by, "__order", "__at", "__last"), allowMissingColumns=True)
    run = W.partitionBy(*by).orderBy("__order", F.col("__node").isNull(), F.col("__at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    seen = F.coalesce(F.last("__last", ignorenulls=True).over(run), F.array().cast(dict(rows.dtypes)["__last"]))
    return both.withColumn("__seen", seen).filter(F.col("__node").isNotNull()).select("__node.*", F.col("__seen").alias(name))
