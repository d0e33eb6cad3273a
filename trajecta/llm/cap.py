"""Problem 1: at most so many records for each contributor, split over strata."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apportion(cells: DataFrame, cap: int, weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds `__quota` to (`__k`, `__s`, `__n`): the cap of each `__k`, by largest remainder over its strata.

    The weights are the strata's row counts, or weight(stratum) as whole numbers. A stratum never gets more than it
    has; the spare slots go, again by largest remainder, to strata in proportion to the rows they have left. One such
    pass is exact: no share of the spare slots is larger than the rows left.
    Ties go to the larger stratum, then to the smaller stratum name.
    """
    of = W.partitionBy("__k")

    def shares(df: DataFrame, slots: Column, w: str, out: str) -> DataFrame:
        df = df.withColumn("__sum", F.sum(w).over(of)).withColumn("__slots", slots)
        df = df.withColumn("__base", F.when(F.col("__sum") > 0, F.expr(f"(__slots * {w}) div __sum")).otherwise(F.lit(0)))
        df = df.withColumn("__rem", F.when(F.col("__sum") > 0, F.expr(f"(__slots * {w}) % __sum")).otherwise(F.lit(0)))
        df = df.withColumn("__left", F.col("__slots") - F.sum("__base").over(of))
        place = F.row_number().over(of.orderBy(F.col("__rem").desc(), F.col("__n").desc(), F.col("__s")))
        extra = ((place <= F.col("__left")) & (F.col("__rem") > 0)).cast("long")
        return df.withColumn(out, F.col("__base") + extra).drop("__sum", "__slots", "__base", "__rem", "__left")

    df = cells.withColumn("__w", (weight(F.col("__s")) if weight else F.col("__n")).cast("long"))
    df = shares(df, F.lit(cap).cast("long"), "__w", "__q")
    df = df.withColumn("__take", F.least("__q", "__n")).withColumn("__room", F.col("__n") - F.col("__take"))
    spare = F.least(F.lit(cap) - F.sum("__take").over(of), F.sum("__room").over(of))
    df = shares(df, spare, "__room", "__more")
    return df.select("__k", "__s", "__n", F.least(F.col("__take") + F.col("__more"), F.col("__n")).alias("__quota"))


def stratified_cap(
    df: DataFrame,
    row_id: str,
    contributor: Column,
    quality: Sequence[tuple[Column, str]],
    cap: int | None = None,
    share: float | None = None,
    stratum: Column | None = None,
    weight: Callable[[Column], Column] | None = None,
    salt: int = 32,
) -> DataFrame:
    """(row_id, `contributor`, `stratum`, `kept`): which rows of each contributor stay under its cap.

    cap is a number of rows, share a share of all rows; the smaller of both holds. The cap is split over the strata
    by `apportion`; inside a stratum the rows rank by quality, a list of (column, "asc" or "desc") with nulls last,
    and then by the smaller row_id.

    Rows without a contributor are always kept. A null stratum is a stratum of its own. Rows that share a row_id stand
    or fall together. An empty table gives no rows; a cap of 0 keeps none; further columns of df don't matter.

    A hot contributor never sits in one task: every (contributor, stratum) is cut to the cap first within `salt`
    slices (a window group limit, so that map tasks send at most cap rows of each slice), and the rest meets only
    after that. Row counts come from a partial aggregate.
    """
    if cap is None and share is None:
        raise ValueError("give a cap or a share")
    if share is not None:
        of_all = int(share * df.count())
        cap = of_all if cap is None else min(cap, of_all)
    ranks = [(F.col(f"__o{i}"), way) for i, (_, way) in enumerate(quality)]
    order = [c.desc_nulls_last() if way == "desc" else c.asc_nulls_last() for c, way in ranks] + [F.col("__id")]
    slim = df.select(
        F.col(row_id).alias("__id"),
        contributor.alias("__k"),
        F.coalesce(stratum.cast("string"), F.lit("")).alias("__s") if stratum is not None else F.lit("").alias("__s"),
        *[c.alias(f"__o{i}") for i, (c, _) in enumerate(quality)],
    )
    owned = slim.filter(F.col("__k").isNotNull())
    quotas = apportion(owned.groupBy("__k", "__s").agg(F.count("*").alias("__n")), cap, weight)
    sliced = W.partitionBy("__k", "__s", "__slice").orderBy(*order)
    first = owned.withColumn("__slice", F.pmod(F.xxhash64("__id"), F.lit(salt)))
    first = first.withColumn("__r", F.dense_rank().over(sliced)).filter(F.col("__r") <= cap)
    ranked = first.join(quotas.filter(F.col("__quota") > 0), ["__k", "__s"])
    ranked = ranked.withColumn("__r", F.dense_rank().over(W.partitionBy("__k", "__s").orderBy(*order)))
    kept = ranked.filter(F.col("__r") <= F.col("__quota")).select("__id", F.lit(True).alias("__kept")).dropDuplicates(["__id"])
    out = slim.select("__id", "__k", "__s").join(kept, "__id", "left")
    return out.select(
        F.col("__id").alias(row_id),
        F.col("__k").alias("contributor"),
        F.col("__s").alias("stratum"),
        (F.col("__k").isNull() | F.coalesce("__kept", F.lit(False))).alias("kept"),
    )
