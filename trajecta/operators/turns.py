"""Conversations: merging, trimming, budgets and boundaries."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions import text as T


def merge_speakers(turns: DataFrame, by: Sequence[str], order: str = "idx", who: str = "who", text: str = "text") -> DataFrame:
    """Consecutive turns of one speaker as one, joined by a blank line; blank turns are gone first: *by, `turn`, who, text."""
    w = W.partitionBy(*by).orderBy(order)
    df = turns.filter(T.strip(T.text_or_empty(text)) != "")
    df = df.withColumn("__new", F.coalesce((F.col(who) != F.lag(who).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("turn", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by, "turn", who).agg(F.array_join(F.transform(got, lambda s: s["t"]), "\n\n").alias(text))


def trim_ends(turns: DataFrame, by: Sequence[str], first: str = "human", last: str = "gpt", who: str = "who") -> DataFrame:
    """Without what stands before the first turn of one speaker and behind the last of the other; conversations of one turn go."""
    a, z = F.min(F.when(F.col(who) == first, F.col("turn"))).alias("__a"), F.max(F.when(F.col(who) == last, F.col("turn"))).alias("__z")
    ends = turns.groupBy(*by).agg(a, z).filter("__z > __a")  # turns are numbered without gaps
    return turns.join(ends, list(by)).filter("turn between __a and __z").drop("__a", "__z")


def up_to(messages: DataFrame, by: Sequence[str], bounds: DataFrame, order: str = "idx", role: str = "role", text: str = "text", width: int = 80) -> DataFrame:
    """The messages before a node's statement.

    bounds has *by, `raw_ref` (a place or null) and `hyp`. A place outside the log doesn't count; then the first
    assistant message that holds the beginning of `hyp` is the bound, and a log without any bound gives nothing.
    """
    key = F.substring(T.fold_key("hyp"), 1, width)
    match = (F.col(role) == "assistant") & (key != "") & F.contains(T.fold_key(text), key)
    said = messages.join(bounds, list(by)).groupBy(*by).agg(F.count("*").alias("__n"), F.max("raw_ref").alias("__ref"), F.min(F.when(match, F.col(order))).alias("__said"))
    place = F.when((F.col("__ref") >= 0) & (F.col("__ref") < F.col("__n")), F.col("__ref"))
    limits = said.select(*by, F.coalesce(place, F.col("__said")).alias("__bound")).filter("__bound is not null")
    return messages.join(limits, list(by)).filter(F.col(order) < F.col("__bound")).drop("__bound")


def head_and_recent(parts: DataFrame, by: Sequence[str], budget: int, order: str = "idx", text: str = "text", head: int = 2, head_cap: int = 8000) -> DataFrame:
    """Which parts fit: the first `head` ones, then the newest while their sum stays in the budget: *by, order, `place`, text.

    A conversation within the budget stays whole. Lengths aren't negative, so that the sum from the end grows and
    keeping what is within is the same as stopping at the first overflow. An oversized newest part is cut, never lost.
    """
    w = W.partitionBy(*by)
    df = parts.withColumn("__len", F.length(text)).withColumn("__n", F.count("*").over(w))
    df = df.withColumn("__i", F.row_number().over(w.orderBy(order)))
    # joined with blank lines
    df = df.withColumn("__total", F.sum("__len").over(w) + 2 * (F.col("__n") - 1))
    in_head = F.col("__i") <= head
    size = F.least(F.sum(F.when(in_head, F.col("__len"))).over(w) + 2 * (F.least(F.col("__n"), F.lit(head)) - 1), F.lit(min(head_cap, budget)))
    df = df.withColumn("__head", size)
    back = w.orderBy(F.col("__i").desc()).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__back", F.sum(F.when(in_head, 0).otherwise(F.col("__len"))).over(back))
    fits = F.col("__head") + F.col("__back") <= budget
    newest = F.col("__i") == F.col("__n")
    alone = newest & ~in_head & ~fits
    whole = F.col("__total") <= budget
    place = F.when(whole, "all").when(in_head, "head").when(fits, "tail").when(alone, "cut")
    keep = F.greatest(F.lit(500), F.lit(budget) - F.col("__head"))
    out = df.withColumn("place", place).filter("place is not null")
    out = out.withColumn(text, F.when(F.col("place") == "cut", F.substr(F.col(text), -F.least(keep, F.col("__len")), keep)).otherwise(F.col(text)))
    return out.select(*by, order, "place", text)


CUT = "\n...[truncated]...\n"


def fit(turns: list[tuple[str, str]], budget: int, floor: int = 300) -> list[tuple[str, str]] | None:
    """Observations halved, the largest first, until all fits; the first turn and the reasoning stay. None if nothing helps.

    Only lengths are halved, in a heap; each text is cut once at the end, as cutting a cut text again leaves the same
    ends of it. An observation that a cut wouldn't shorten, because of `floor` or the mark, is left alone.
    """
    over, kept = sum(len(t) for _, t in turns) - budget, {}
    heap = [(-len(t), i) for i, (who, t) in enumerate(turns) if i and who == "human"]
    heapq.heapify(heap)
    while over > 0 and heap:
        size, i = -heap[0][0], heap[0][1]
        half = max(floor, size // 2)
        if half + len(CUT) < size:
            kept[i], over = half, over - size + half + len(CUT)
            heapq.heapreplace(heap, (-half - len(CUT), i))
        else:
            heapq.heappop(heap)
    if over > 0:
        return None
    ends = lambda t, n: t[: n // 2] + CUT + t[len(t) - (n + 1) // 2 :]
    return [(who, ends(t, kept[i]) if i in kept else t) for i, (who, t) in enumerate(turns)]


def fit_conversations(df: DataFrame, turns: str, budget: int, floor: int = 300) -> DataFrame:
    """df with turns (an array of who and text) fitted to a budget, null where reasoning alone overflows. Runs in Arrow batches."""
    schema = df.schema

    def run(batches):
        for b in batches:
            got = [fit([(t["who"], t["text"]) for t in x], budget, floor) if x is not None else None for x in b[turns]]
            b[turns] = pd.Series([None if g is None else [{"who": w, "text": t} for w, t in g] for g in got], dtype=object)
            yield b

    return df.mapInPandas(run, schema)
