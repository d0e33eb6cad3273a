"""Problem 6: records that differ only in their form, collapsed over dictionary-encoded columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.session import cut, spread

#: Labels whose lines may come in any order.
LINE_LABELS = ("HYPOTHESIS", "REASONING", "CHECK")


def bare(text: Column) -> Column:
    """Letters and digits only, letter case folded (both ways, so that `ß` meets `SS`); null counts as empty."""
    # the optimiser takes a lower right around an upper for a lower alone
    return F.lower(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", ""))


def bare_lines(text: Column, labels: tuple[str, ...] = LINE_LABELS) -> Column:
    """As bare, but a labelled line counts at any place among the labelled lines of its text."""
    head = rf"(?i)^[^\p{{L}}\p{{N}}]*(?:{'|'.join(labels)})[^\p{{L}}\p{{N}}]*:"
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    labelled = F.array_sort(F.transform(F.filter(lines, lambda x: x.rlike(head)), bare))
    rest = bare(F.array_join(F.filter(lines, lambda x: ~x.rlike(head)), " "))
    return F.concat_ws("\u001f", rest, F.array_join(labelled, "\u001e"))


def fold_copies(df: DataFrame, row_id: str, columns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(row_id, `first_id`, `n_copies`): the group of each record, named by its smallest row_id.

    columns says for each column how its values are canonicalised. Each column is dictionary-encoded: a value's
    canonical form gets one integer identifier, the smallest row_id that carries it, so that identifiers are whole
    numbers without a counter and the same in every run. Records are rewritten as tuples of these integers and only
    the tuples are grouped.

    Canonical forms never leave the scan: what moves is their 128-bit fingerprint. A value seen once can't belong to a
    repeated record, so each encoding step drops its record; what passes all steps is small. The most distinct columns
    should come first. A hot value is counted by a partial aggregate and met in a join that AQE may split.

    Nulls count as empty texts, so that records with null and empty values are copies. row_id must be unique and not
    null. An empty table gives no rows. Other columns don't matter.
    """
    names = [f"__c{i}" for i in range(len(columns))]
    prints = [F.unhex(F.md5(canon(F.col(c)).cast("binary"))).alias(n) for n, (c, canon) in zip(names, columns.items())]
    slim = spread(df.select(row_id, *columns))
    all_rows = cut(slim.select(F.col(row_id).alias("__id"), *prints))
    coded = all_rows
    for n in names:
        codes = coded.groupBy(n).agg(F.min("__id").alias("__code"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
        coded = cut(coded.join(codes, n).drop(n).withColumnRenamed("__code", n))
    groups = coded.groupBy(*names).agg(F.min("__id").alias("first_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    copies = coded.join(groups, names).select("__id", "first_id", "n_copies")
    out = all_rows.select("__id").join(copies, "__id", "left")
    return out.select(
        F.col("__id").alias(row_id), F.coalesce("first_id", "__id").alias("first_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")
    )
