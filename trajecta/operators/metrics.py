"""Evaluation: rates, slices, agreement, intervals and best-of-n curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(flag: Column, among: Column | None = None, digits: int = 6) -> Column:
    """The share of true flags; null flags, and rows outside `among`, don't count."""
    value = flag.cast("double") if among is None else F.when(among, flag.cast("double"))
    return F.round(F.avg(value), digits)


def slices(df: DataFrame, dims: Sequence[str], flag: Column, digits: int = 6) -> DataFrame:
    """(`dim`, `value`, `n`, `acc`) for each value of each dimension: one pass over grouping sets."""
    df = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("none")).alias(d) for d in dims], flag.cast("double").alias("__y"))
    grouped = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), F.round(F.avg("__y"), digits).alias("acc"))
    dim, value = F.when(F.lit(False), F.lit("")), F.coalesce(*[F.col(d) for d in dims])
    for d in dims:
        dim = dim.when(F.col(d).isNotNull(), d)
    return grouped.select(dim.alias("dim"), value.alias("value"), "n", "acc")


def marginals(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner) and, with `all` for outer, by inner."""
    df = df.select(F.coalesce(F.col(outer).cast("string"), F.lit("none")).alias(outer), F.coalesce(F.col(inner).cast("string"), F.lit("none")).alias(inner))
    o, i = F.col(outer), F.col(inner)
    grouped = df.groupingSets([[o, i], [i]], o, i).agg(F.count("*").alias("n"))
    return grouped.select(F.coalesce(outer, F.lit("all")).alias(outer), inner, "n")


def two_arms(df: DataFrame, keys: Sequence[str], arms: dict[str, str], arm: str = "arm", value: str = "value") -> DataFrame:
    """One row for each arm instead of one column."""
    return df.unpivot(list(keys), list(arms), arm, value).replace({k: v for k, v in arms.items()}, subset=[arm])


def pearson(x: str, y: str, digits: int = 6) -> Column:
    """Pearson's r; 0 with fewer than three rows or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.round(F.when(F.count_if(both) < 3, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0))), digits)


def node_summary(cands: DataFrame, node: str = "node_id", idx: str = "cand_idx", score: str = "score", right: str = "right") -> DataFrame:
    """(node, `k`, `frac_right`, `first_right`, `picked_right`): the pick has the best score, on ties the first."""
    best = F.struct(F.col(score), (-F.col(idx)).alias("i"))
    return cands.groupBy(node).agg(
        F.count("*").alias("k"),
        F.round(F.avg(F.col(right).cast("double")), 6).alias("frac_right"),
        F.min_by(F.col(right).cast("int"), idx).alias("first_right"),
        F.max_by(F.col(right).cast("int"), best).alias("picked_right"),
    )


def mixed(cands: DataFrame, node: str = "node_id", label: str = "label") -> DataFrame:
    """The nodes with a correct and a wrong candidate."""
    got = cands.groupBy(node).agg(F.bool_or(F.col(label) == "correct").alias("__a"), F.bool_or(F.col(label) == "wrong").alias("__b"))
    return got.filter("__a and __b").select(node)


def best_of_n(cands: DataFrame, most: int = 8, node: str = "node_id", idx: str = "cand_idx", score: str = "score", right: str = "right", digits: int = 6) -> DataFrame:
    """(`n`, `nodes`, `accuracy`): how often the best-scored of n random candidates is right, over nodes with at least n.

    In closed form: a candidate with r better ones is the best of C(k-1-r, n-1) of the C(k, n) draws. The quotient is
    a product of n factors, so that no factorial overflows.
    """
    w = W.partitionBy(node)
    df = cands.withColumn("__k", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.col(score).desc(), idx)) - 1)
    df = df.select(node, "__k", "__r", F.col(right).cast("int").alias("__y"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n")).filter("__k >= n")
    # C(k-1-r, n-1) / C(k, n) = n/k * prod_{j=1}^{n-1} (k-r-j)/(k-j)
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    factor = lambda j: F.greatest(F.col("__k") - F.col("__r") - j, F.lit(0)).cast("double") / (F.col("__k") - j)
    p = F.aggregate(steps, F.col("n").cast("double") / F.col("__k"), lambda acc, j: acc * factor(j))
    per = df.groupBy("n", node).agg(F.sum(F.col("__y") * p).alias("__p"))
    return per.groupBy("n").agg(F.count("*").alias("nodes"), F.round(F.avg("__p"), digits).alias("accuracy"))


def bootstrap(df: DataFrame, value: str, by: Sequence[str] = (), draws: int = 2000, seed: int = 0) -> DataFrame:
    """(*by, `n`, `mean`, `low`, `high`): a 95 % percentile interval of the mean, by resampling counts of distinct values.

    The values of a group are first counted (a partial aggregate); a draw is then a multinomial over the counts, so
    that a group costs its distinct values and never its rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    kinds = dict(df.dtypes)
    schema = "".join(f"{b} {kinds[b]}, " for b in by) + "n bigint, mean double, low double, high double"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, c = pdf["v"].to_numpy(), pdf["c"].to_numpy(dtype=np.int64)
        n = int(c.sum())
        # a few draws at a time, so that many distinct values cost memory once
        rng, some = np.random.default_rng(seed), max(1, 2_000_000 // len(v))
        means = np.sort(np.concatenate([rng.multinomial(n, c / n, size=min(some, draws - i)) @ v / n for i in range(0, draws, some)]))
        row = {b: [pdf[b].iloc[0]] for b in by}
        return pd.DataFrame(row | {"n": [n], "mean": [float(c @ v / n)], "low": [means[int(0.025 * draws)]], "high": [means[int(0.975 * draws)]]})

    keyed = counts if by else counts.withColumn("__all", F.lit(1))
    return keyed.groupBy(*(by or ["__all"])).applyInPandas(draw, schema)


def quantile_at(df: DataFrame, by: Sequence[str], x: str, q: float, name: str, slack: float = 0.002) -> DataFrame:
    """The value at floor(q * n), from 0, of each group's order, exactly.

    A quantile sketch (a partial aggregate of bounded size, its rank error a tenth of the slack or less) brackets the
    value; below the bracket rows are only counted, and only the bracket's distinct values are ordered.
    """
    keys, rows = list(by), df.filter(F.col(x).isNotNull()).select(*by, F.col(x).alias("__x"))
    edges = F.percentile_approx("__x", [max(0.0, q - slack), min(1.0, q + slack)], int(10 / slack))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), edges.alias("__e"))
    near = rows.join(ends.select(*keys, F.col("__e")[0].alias("__lo"), F.col("__e")[1].alias("__hi"), F.floor(F.lit(q) * F.col("__n")).alias("__k")), keys)
    cells = near.filter("__x <= __hi").groupBy(*keys, "__k", F.when(F.col("__x") >= F.col("__lo"), F.col("__x")).alias("__v")).agg(F.count("*").alias("__c"))
    run = F.sum("__c").over(W.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn("__run", run).filter("__v is not null and __run > __k").groupBy(*keys).agg(F.min("__v").alias(name))


def spread(*scores: str) -> Column:
    """The range of all scores of a table."""
    return F.max(F.greatest(*scores)) - F.min(F.least(*scores))


def signature(labels: Column) -> Column:
    """Which labels a list holds, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), "/")


def ratio(top: Column, bottom: Column, digits: int = 6) -> Column:
    """A quotient of sums, null for an empty denominator."""
    return F.round(F.try_divide(F.sum(top).cast("double"), F.sum(bottom).cast("double")), digits)


def submit_behaviour(log: DataFrame, by: Sequence[str], order: str, submit: Column, failed: Column, test: Column, opens: Column) -> DataFrame:
    """(*by, `premature`, `failed_attempts`, `redirects`) of each log.

    premature: nothing was tested before the first submission (null without one). redirects: failed submissions after
    which a new card opens. Three partial aggregates give the places that the second look counts against.
    """
    at = lambda agg, what: agg(F.when(what, F.col(order)))
    ends = log.groupBy(*by).agg(at(F.min, submit).alias("__submit"), at(F.min, test).alias("__test"), at(F.max, opens).alias("__open"))
    fails = log.filter(failed).join(ends.select(*by, "__open"), list(by)).groupBy(*by)
    fails = fails.agg(F.count("*").alias("failed_attempts"), F.count_if(F.col("__open") > F.col(order)).alias("redirects"))
    out = ends.join(fails, list(by), "left")
    premature = F.when(F.col("__submit").isNotNull(), F.coalesce(F.col("__test") > F.col("__submit"), F.lit(True)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(*by, premature.alias("premature"), zero("failed_attempts"), zero("redirects"))


def emission_counters(cands: DataFrame, item: str, text: str, extracted: Column) -> DataFrame:
    """(`items`, `candidates_scored`, `extract_fallback`, `extract_fallback_frac`): what a run over candidates emitted.

    A candidate whose text the extraction doesn't fit is scored whole: a fallback. The share is null without candidates.
    """
    fell = (~F.coalesce(extracted, F.lit(False))).cast("int")
    return cands.agg(
        F.countDistinct(item).alias("items"), F.count("*").alias("candidates_scored"), F.coalesce(F.sum(fell), F.lit(0)).cast("bigint").alias("extract_fallback"), F.round(F.avg(fell), 3).alias("extract_fallback_frac")
    )


def selection_report(nodes: DataFrame, subsets: dict[str, Column], picks: Sequence[str], base: str) -> DataFrame:
    """(`subset`, `n`, a mean of each pick, `delta_<pick>` against base): a block for each subset of nodes, nulls where it is empty.

    One pass: each node goes once into every subset that it belongs to.
    """
    rows = nodes.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in subsets.items()]))))
    means = [F.round(F.avg(p), 6).alias(p) for p in picks] + [F.round(F.avg(p) - F.avg(base), 6).alias(f"delta_{p}") for p in picks if p != base]
    got = rows.groupBy("subset").agg(F.count("*").alias("n"), *means)
    names = nodes.sparkSession.createDataFrame([(x,) for x in subsets], "subset string")
    return names.join(got, "subset", "left").withColumn("n", F.coalesce("n", F.lit(0)))
