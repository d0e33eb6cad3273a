"""Line ranges: hunks of a patch, widened and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hunks(df: DataFrame, keys: Sequence[str], patch: str) -> DataFrame:
    """(*keys, `at`, `file`, `start`, `end`) of a unified diff's hunks on the old side; a hunk before any file is dropped.

    The end is one past the last line, and an empty hunk has one line.
    """
    lines = df.select(*keys, F.posexplode(F.split(patch, r"\R")).alias("at", "line"))
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    file = F.nullif(F.trim(F.regexp_extract("line", r"^\+\+\+ b/(.+)", 1)), F.lit(""))
    lines = lines.filter(F.col("line").startswith("+++ b/") | F.col("line").startswith("@@ -")).withColumn("file", F.last(file, ignorenulls=True).over(w))
    start = F.regexp_extract("line", r"^@@ -(\d+)", 1)
    size = F.coalesce(F.nullif(F.regexp_extract("line", r"^@@ -\d+,(\d+)", 1), F.lit("")), F.lit("1"))
    out = lines.filter((start != "") & F.col("file").isNotNull())
    return out.select(*keys, "at", "file", start.cast("bigint").alias("start"), (start.cast("bigint") + F.greatest(size.cast("bigint"), F.lit(1))).alias("end"))


def merged(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", widen: int = 0, gap: int = 1, floor: int = 1) -> DataFrame:
    """Ranges of each group, widened on both sides, merged where one begins at most `gap` behind another's end.

    Gaps and islands: a range opens an island if it begins beyond all ends so far. (*by, start, end)
    """
    df = df.select(*by, F.greatest(F.col(start) - widen, F.lit(floor)).alias(start), (F.col(end) + widen).alias(end))
    w = W.partitionBy(*by).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col(start) > far + gap).cast("int"), F.lit(1)))
    df = df.withColumn("__isle", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(*by, "__isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__isle")


def changed_lines(patch: Column) -> Column:
    """How many lines a unified diff adds or removes."""
    return F.size(F.filter(F.split(patch, r"\R"), lambda s: s.rlike(r"^[+-]") & ~s.startswith("+++") & ~s.startswith("---")))


def changed_files(patch: Column) -> Column:
    """The files that a unified diff writes, each once."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(.+)"), F.lit(1)))


def complexity(patch: Column, n_tests: Column) -> Column:
    """A proxy of difficulty from capped counts: source files (15 each, up to 5), lines (up to 100), tests (3 each, up to 4)."""
    source = F.filter(changed_files(patch), lambda f: ~F.contains(f, F.lit("/test")) & ~F.element_at(F.split(f, "/"), -1).startswith("test"))
    return F.least(F.size(source), F.lit(5)) * 15 + F.least(changed_lines(patch), F.lit(100)) + F.least(n_tests, F.lit(4)) * 3
