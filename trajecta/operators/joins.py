"""Look-ups, walls and merges that the pipelines share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits_broadcast(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 32 << 20) -> bool:
    """Whether a side has at most so many rows and bytes (of its rows as JSON); looks no further than that many rows."""
    head = df.limit(most_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    got = head.agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return got["n"] <= most_rows and got["b"] <= most_bytes


def lookup(df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "inner", most_rows: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A join that broadcasts the table only if it is small in rows and bytes, and is left to the optimiser if not."""
    return df.join(F.broadcast(table) if fits_broadcast(table, most_rows, most_bytes) else table, on, how)


def beyond_wall(df: DataFrame, wall: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't held out."""
    return df.join(wall.select(key).distinct(), key, "left_anti")


def wall_hits(df: DataFrame, wall: DataFrame, key: str) -> DataFrame:
    return df.join(wall.select(key).distinct(), key, "left_semi")


def last_wins(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """One row for each key, the last by order: a partial aggregate over structs, no sort."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, key: str | Sequence[str], order: str | Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def by_number_or_place(cards: DataFrame, entries: DataFrame, by: Sequence[str], number: str, place: str) -> DataFrame:
    """Cards with the entry of their number; an entry without a readable number goes by its place, the first one wins."""
    said = F.expr(f"try_cast({number} as int)")
    keyed = entries.withColumn(number, F.coalesce(said, F.col(place) + 1))
    return cards.join(first_wins(keyed, [*by, number], place), [*by, number], "left")


def with_default(df: DataFrame, table: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """A left join whose missing values are given ones."""
    out = df.join(table, on, "left")
    return out.fillna({k: v for k, v in defaults.items()})


def merged_tables(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keyed tables one over the other: later ones overwrite."""
    out = parts[0].withColumn("__o", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("__o", F.lit(i)), allowMissingColumns=True)
    return last_wins(out, key, "__o").drop("__o")


def added_lines(after: DataFrame, before: DataFrame) -> DataFrame:
    """What the one has beyond the other, each line as many times as it has more of it (a difference of multisets)."""
    return after.exceptAll(before.select(*after.columns))


def all_targets(*parts: DataFrame) -> DataFrame:
    """The rows of any of the tables, each once; columns go by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def candidates_of_items(items: DataFrame, cands: DataFrame, item: str, owner: str = "instance_id", sep: str = "::") -> DataFrame:
    """Items with their candidates and the instance that the item's name begins with; items without candidates are left out."""
    return items.join(cands, item).withColumn(owner, F.split_part(F.col(item), F.lit(sep), F.lit(1)))


def tagged_union(parts: dict[str, DataFrame], tag: str = "channel") -> DataFrame:
    """All rows of named tables with where they come from; a column that a table lacks is null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def in_order(df: DataFrame, key: str, before: Column, how: str = "first") -> DataFrame:
    """The first (or last) order value of each key among the rows that fit."""
    agg = F.min if how == "first" else F.max
    return df.groupBy(key).agg(agg(before).alias("at"))
