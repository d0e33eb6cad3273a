"""Preference pairs from labelled or ranked candidates of a node.

Every join has the node as an equi-key; gates are residual predicates inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions import fixed
from trajecta.functions import text as T


def _two(df: DataFrame, good: DataFrame, node: str) -> DataFrame:
    a = good.select(node, *[F.col(c).alias(f"{c}_a") for c in good.columns if c != node])
    return a.join(df.select(node, *[F.col(c).alias(f"{c}_b") for c in df.columns if c != node]), node)


def sibling_pairs(cands: DataFrame, node: str = "node_id", label: str = "label", text: str = "text") -> DataFrame:
    """Each correct candidate with each wrong one of its node, equal texts aside."""
    both = _two(cands.filter(F.col(label) == "wrong"), cands.filter(F.col(label) == "correct"), node)
    return both.filter(T.fold_key(f"{text}_a") != T.fold_key(f"{text}_b"))


def worse_than_anchor(cands: DataFrame, anchors: DataFrame, node: str = "node_id", label: str = "label", text: str = "text", not_worse: DataFrame | None = None) -> DataFrame:
    """Each node's anchor with the candidates on a lower step of the label ladder (unknown labels stand lowest)."""
    both = _two(cands, anchors, node)
    rank = lambda c: T.ladder(c, fixed.LABEL_LADDER)
    out = both.filter((rank(f"{label}_b") < rank(f"{label}_a")) & (F.col(f"{text}_a") != F.col(f"{text}_b")))
    if not_worse is None:
        return out
    return out.join(not_worse.select(node, F.col(text).alias(f"{text}_b")).distinct(), [node, f"{text}_b"], "left_anti")


def rank_gap_pairs(cands: DataFrame, node: str = "node_id", rank: str = "rank", label: str = "label", text: str = "text") -> DataFrame:
    """Pairs of a node by rank, better first, with `gap`; a pair whose labels contradict the ranks is vetoed, nulls pass."""
    both = _two(cands, cands, node).withColumn("gap", F.col(f"{rank}_b") - F.col(f"{rank}_a"))
    step = lambda c: T.ladder(c, fixed.LABEL_LADDER, None)
    veto = F.coalesce(step(f"{label}_b") > step(f"{label}_a"), F.lit(False))
    return both.filter((F.col("gap") > 0) & ~veto & (F.col(f"{text}_a") != F.col(f"{text}_b")))


def tiers_of(rankings: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, `cand`, `tier`) from groups of candidate numbers and a tier for each group."""
    zipped = rankings.select(node, F.posexplode("groups").alias("g", "members"), "tiers")
    return zipped.select(node, F.explode("members").alias("cand"), F.try_element_at("tiers", F.col("g") + 1).alias("tier"))


def rank_positions(rankings: DataFrame, node: str = "node_id", groups: str = "groups", ranking: str = "ranking", tiers: str = "tiers") -> DataFrame:
    """(node, `cand`, `rank`): each candidate's place, 0 the best, from groups of equal candidates and their order.

    ranking orders the numbers of the groups (from 0), best first. Where a judge gave tiers, the place is that of the
    tier, as groups of one tier don't differ. Nodes with one group only (clones) give nothing.
    """
    top = max(fixed.TIER_LADDER.values())
    step = lambda t: top - T.ladder(t, fixed.TIER_LADDER)
    rows = rankings.filter(F.size(groups) > 1).select(node, F.posexplode(groups).alias("__g", "__members"), F.col(ranking).alias("__r"), F.col(tiers).alias("__t"))
    place = F.when(F.size("__t") > 0, step(F.try_element_at("__t", F.col("__g") + 1))).otherwise(F.array_position("__r", F.col("__g")).cast("int") - 1)
    return rows.select(node, F.explode("__members").alias("cand"), place.alias("rank")).filter("rank >= 0")


def not_worse(rankings: DataFrame, cands: DataFrame, node: str = "node_id", number: str = "cand_idx", text: str = "text") -> DataFrame:
    """(node, text) of the candidates that a judge puts on par or above."""
    par = tiers_of(rankings, node).filter(F.col("tier").isin("par", "above"))
    return par.join(cands.withColumnRenamed(number, "cand"), [node, "cand"]).select(node, text).distinct()


def above_the_real(rankings: DataFrame, cands: DataFrame, real: DataFrame, node: str = "node_id", number: str = "cand_idx", text: str = "text") -> DataFrame:
    """Each candidate above par with its node's real text, equal ones aside."""
    top = tiers_of(rankings, node).filter(F.col("tier") == "above").join(cands.withColumnRenamed(number, "cand"), [node, "cand"])
    return top.select(node, F.col(text).alias("chosen")).join(real.select(node, F.col(text).alias("rejected")), node).filter(T.fold_key("chosen") != T.fold_key("rejected"))


def label_of_text(cands: DataFrame, labels: str, texts: str) -> Column:
    """A map from folded text to label out of parallel arrays; of texts that fold alike the last one wins."""
    return T.last_of_key(F.arrays_zip(F.transform(texts, T.fold_key).alias("k"), F.col(labels).alias("v")), "k")


def valid_partition(groups: Column, k: Column) -> Column:
    """Whether groups hold each of 1..k once."""
    flat = F.array_sort(F.flatten(groups))
    return F.coalesce(flat == F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(False))


def valid_ranking(ranking: Column, groups: Column) -> Column:
    """Whether a ranking orders all groups once."""
    return valid_partition(F.array(ranking), F.size(groups))


def valid_tiers(tiers: Column, groups: Column) -> Column:
    return F.coalesce((F.size(tiers) == F.size(groups)) & F.forall(tiers, lambda t: t.isin(*fixed.TIER_LADDER)), F.lit(False))


def unshuffled(groups: Column, order: Column) -> Column:
    """Group members renumbered from the shuffled to the original places."""
    return F.transform(groups, lambda g: F.transform(g, lambda n: F.element_at(order, n)))


def real_last_dropped(xs: Column, has_real: Column) -> Column:
    """An array without its last slot where that one holds the real candidate."""
    return F.when(has_real, F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))).otherwise(xs)
