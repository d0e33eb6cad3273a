"""Problem 5: splits that keep related records together, by grouped iterative stratification."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.session import cut, parallelism


def contract(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(`node`, `root`): each node of the edges (a, b), a > b, that isn't its component's smallest, with the smallest.

    Alternating large-star and small-star steps, each cut by a checkpoint, until the edges stay the same; about
    log(n) rounds. A hub's edges are joined by its key, which AQE may split, never collected.
    """
    sums = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))]
    edges = cut(edges.select("a", "b").distinct())
    before = edges.agg(*sums).first()
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(low.select("a", F.col("m").alias("b")).union(small).distinct())
        now = after.agg(*sums).first()
        if now == before:  # the same edges
            return after.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        edges, before = after, now
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def components(df: DataFrame, row_id: str, keys: Sequence[Column], max_rounds: int = 60) -> DataFrame:
    """(row_id, `component`): rows that share a value of any key, directly or through others, get one component.

    A component is named by its smallest tagged key (`0|org|proj|12`); values of different keys are different things.
    A row without any key is a component of its own, named `-|` and its row_id. Nulls link nothing.

    With one key the key is the component and nothing moves. With several, rows link their keys as stars, and the
    distinct keys (not the rows) contract (`contract`).
    """
    tagged = [F.when(k.isNotNull(), F.concat(F.lit(f"{i}|"), k.cast("string"))) for i, k in enumerate(keys)]
    own = F.concat(F.lit("-|"), F.col(row_id).cast("string"))
    rows = df.select(F.col(row_id).alias("__id"), F.array_compact(F.array(*tagged)).alias("__keys"), own.alias("__own"))
    rows = rows.withColumn("__first", F.try_element_at("__keys", F.lit(1)))
    if len(keys) == 1:
        return rows.select(F.col("__id").alias(row_id), F.coalesce("__first", "__own").alias("component"))
    edges = cut(
        rows.filter(F.size("__keys") > 1)
        .select(F.col("__first").alias("a"), F.explode(F.slice("__keys", 2, 1 << 20)).alias("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    names = contract(edges, max_rounds).select(F.col("node").alias("__first"), F.col("root").alias("__name"))
    out = rows.join(names, "__first", "left")
    return out.select(F.col("__id").alias(row_id), F.coalesce("__name", "__first", "__own").alias("component"))


def place(vectors: np.ndarray, order: Sequence[str], want: np.ndarray) -> np.ndarray:
    """The split of each group: the rarest outstanding label goes first, into the split that needs it most.

    vectors: groups x labels (counts); want: labels x splits (records still wanted), changed in place. Of the splits
    that still want as many records of the label as the group has, the one with the largest part of its share open needs
    it most, so that small groups are dealt out in proportion all along and the other labels with them; where none does,
    the one that wants most records. Ties go to the split with more of its total open, to the one that wants more in all,
    then to the first split; larger groups of a label go first, then by order.
    """
    n, n_labels = vectors.shape
    out, left = np.full(n, -1), vectors.sum(axis=0).astype(float)
    size = vectors.sum(axis=1)
    queues: list[list[tuple]] = [[] for _ in range(n_labels)]
    for i, j in zip(*np.nonzero(vectors)):
        queues[j].append((-int(vectors[i, j]), -int(size[i]), order[i], int(i)))
    for q in queues:
        heapq.heapify(q)
    total = want.sum(axis=0)
    goal, goals = np.maximum(want, 1e-9), np.maximum(total, 1e-9)

    def need(s: int, i: int, j: int) -> tuple:
        fits = want[j, s] >= vectors[i, j]
        return bool(fits), round(want[j, s] / (goal[j, s] if fits else 1.0), 9), round(total[s] / goals[s], 9), round(total[s], 9), -s

    while True:
        open_ = [j for j in range(n_labels) if queues[j]]
        if not open_:
            break
        j = min(open_, key=lambda x: (left[x], x))
        i = heapq.heappop(queues[j])[3]
        if out[i] >= 0:
            continue
        best = max(range(want.shape[1]), key=lambda s: need(s, i, j))
        out[i] = best
        want[:, best] -= vectors[i]
        total[best] -= size[i]
        left -= vectors[i]
    out[out < 0] = int(np.argmax(total))
    return out


def stratified_splits(
    df: DataFrame,
    row_id: str,
    keys: Sequence[Column],
    label: Column,
    proportions: Mapping[str, float],
    heavy_share: float = 0.002,
    block: int = 20_000,
    max_labels: int = 256,
) -> DataFrame:
    """(row_id, `component`, `split`): whole components go to splits so that each label keeps the proportions.

    Components come from `components`; each is summed up as a vector of label counts. Iterative stratification places
    first the heavy components, those with more than heavy_share of a label's rows (at most labels / heavy_share of
    them, so the driver may hold them), then the others in blocks of about `block` components, each block with its
    part of what the heavy ones left open. A block is one bounded task; no list of all components is ever collected.

    Null labels are a label of their own. Rows that share a row_id must share their keys. An empty table gives no
    rows. More than max_labels labels are refused: they are no strata.
    """
    parts = components(df, row_id, keys)
    names = list(proportions)
    ratio = np.array([proportions[x] for x in names], dtype=float)
    ratio = ratio / ratio.sum()
    labels_of = df.select(F.col(row_id).alias("__id"), F.coalesce(label.cast("string"), F.lit("")).alias("__label"))
    rows = parts.withColumnRenamed(row_id, "__id").join(labels_of, "__id") if len(keys) > 1 else df.select(
        F.col(row_id).alias("__id"), F.coalesce(label.cast("string"), F.lit("")).alias("__label"),
        F.coalesce(F.concat(F.lit("0|"), keys[0].cast("string")), F.concat(F.lit("-|"), F.col(row_id).cast("string"))).alias("component"),
    )
    cells = cut(rows.groupBy("component", "__label").agg(F.count("*").alias("__n")))
    totals = {r["__label"]: r["n"] for r in cells.groupBy("__label").agg(F.sum("__n").alias("n")).limit(max_labels + 1).collect()}
    if len(totals) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels = sorted(totals)
    want = np.array([[totals[x] * r for r in ratio] for x in labels]).reshape(len(labels), len(names))
    floor = F.lit(None).cast("double")
    for x in labels:
        floor = F.when(F.col("__label") == x, F.lit(max(1.0, heavy_share * totals[x]))).otherwise(floor)
    heavy = cells.filter(F.col("__n") > floor).select("component").distinct()
    heavy_cells = cells.join(heavy, "component", "left_semi").collect()
    at, where = {x: i for i, x in enumerate(labels)}, {}
    for r in heavy_cells:
        where.setdefault(r["component"], np.zeros(len(labels)))[at[r["__label"]]] += r["__n"]
    order = sorted(where)
    chosen = place(np.array([where[x] for x in order]).reshape(len(order), len(labels)), order, want)
    spark = df.sparkSession
    placed = spark.createDataFrame([(c, names[s]) for c, s in zip(order, chosen)], "component string, split string")
    rest = cells.join(heavy, "component", "left_anti")
    n_rest = rest.select("component").distinct().count()
    blocks = max(1, -(-n_rest // block))
    open_ = np.clip(want, 0, None)
    open_ = open_ / np.where(open_.sum(axis=1, keepdims=True) > 0, open_.sum(axis=1, keepdims=True), 1)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        groups, who = np.unique(pdf["component"].to_numpy(dtype=object).astype(str), return_inverse=True)
        vectors = np.zeros((len(groups), len(labels)), dtype=np.int64)
        np.add.at(vectors, (who, [at[x] for x in pdf["__label"]]), pdf["__n"].to_numpy())
        got = place(vectors, list(groups), open_ * vectors.sum(axis=0)[:, None])
        return pd.DataFrame({"component": groups, "split": [names[s] for s in got]})

    rest = rest.withColumn("__block", F.pmod(F.xxhash64("component"), F.lit(blocks)))
    rest = rest.repartition(min(blocks, parallelism(spark)), "__block")  # few bytes, but much work
    settled = rest.groupBy("__block").applyInPandas(settle, "component string, split string")
    out = rows.join(placed.union(settled), "component")
    return out.select(F.col("__id").alias(row_id), "component", "split")


def spelling_pairs(strings: DataFrame, column: str, key: Column) -> DataFrame:
    """(`a`, `b`): distinct strings of one component, a before b in byte order.

    The strings of a component are its spellings, few however many rows use them; they meet in an equi-join.
    """
    said = strings.select(F.col(column).alias("s")).filter(F.col("s").isNotNull()).distinct().withColumn(column, F.col("s"))
    found = cut(components(said, "s", [key]))
    return found.alias("x").join(found.alias("y"), "component").filter("x.s < y.s").select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))
