"""Deterministic picks by SHA-1, the same whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_mod(x: Column, m: int) -> Column:
    """SHA-1 of a text as a whole number modulo m: three chunks of its hex digits, recombined modulo m."""
    h = F.sha1(x.cast("binary"))
    chunk = lambda start, n: F.conv(F.substring(h, start, n), 16, 10).cast("long") % F.lit(m)
    first, second, third = chunk(1, 15), chunk(16, 15), chunk(31, 10)
    shift = lambda digits: F.lit(pow(16, digits, m))
    return (((first * shift(15) + second) % F.lit(m)) * shift(10) + third) % F.lit(m)


def hash_order(seed: str, *keys: Column) -> Column:
    """A seeded order of rows by a stable key: a shuffle that any partitioning repeats."""
    return F.sha1(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def split_bucket(x: Column, bounds: Sequence[tuple[str, int]]) -> Column:
    """The split of an id: the first whose upper bound lies above its hash modulo 100."""
    b, out = sha_mod(x, 100), F.when(F.lit(False), F.lit(""))
    for name, upper in bounds:
        out = out.when(b < upper, name)
    return out


def pick_variant(x: Column, share: float, names: Sequence[str]) -> Column:
    """One of the names for a share of the ids, null for the others."""
    h = sha_mod(x, 10_000 * len(names))
    out = F.when(F.lit(False), F.lit(""))
    for i, name in enumerate(names):
        out = out.when(F.floor(h / 10_000) == i, name)
    return F.when(h % 10_000 < int(share * 10_000), out)


def one_in(x: Column, n: int) -> Column:
    return sha_mod(x, n) == 0
