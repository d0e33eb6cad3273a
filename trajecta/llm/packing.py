"""Problem 8: items of varying length in containers of one capacity, by multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.session import cut, parallelism


def differencing(sizes: np.ndarray, ways: int) -> list[list[int]]:
    """Karmarkar-Karp for `ways` subsets: the item numbers of each.

    Every item starts as a partition of its own. The two partitions with the largest differences are merged, the
    largest sum of one onto the smallest of the other, so that their imbalances cancel; at the end one is left.
    Ties go by item number, so that the result depends on the sizes only.
    """
    n = len(sizes)
    if n == 0:
        return []
    if ways <= 1:
        return [list(range(n))]
    left, right = [-1] * n, [-1] * n  # contents of a subset as a binary tree over items 0..n-1
    heap = []
    for i, x in enumerate(sizes):
        sums, what = np.zeros(ways, dtype=np.int64), np.full(ways, -1, dtype=np.int64)
        sums[0], what[0] = x, i
        heap.append((-int(x), i, sums, what))
    heapq.heapify(heap)
    for serial in range(n, 2 * n - 1):
        _, _, s1, w1 = heapq.heappop(heap)
        _, _, s2, w2 = heapq.heappop(heap)
        s, w2 = s1 + s2[::-1], w2[::-1]
        both = (w1 >= 0) & (w2 >= 0)
        what = np.where(w1 >= 0, w1, w2)
        for j in np.nonzero(both)[0]:
            left.append(int(w1[j]))
            right.append(int(w2[j]))
            what[j] = len(left) - 1
        order = np.argsort(-s, kind="stable")
        s, what = s[order], what[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), serial, s, what))
    out = []
    for node in heap[0][3]:
        items, todo = [], [int(node)] if node >= 0 else []
        while todo:
            x = todo.pop()
            if left[x] < 0:
                items.append(x)
            else:
                todo += (left[x], right[x])
        if items:
            out.append(sorted(items))
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Windows that any packing needs: by the total, and by items of which no two share a window.

    For every threshold t up to half the capacity, items over capacity - t can't share with one of at least t, and items
    over half can't share with each other; the others of at least t fill at best what those over half leave open.
    """
    x = np.sort(np.asarray(sizes, dtype=np.int64))[::-1]
    if not len(x):
        return 0
    total = np.concatenate([[0], np.cumsum(x)])
    upto = lambda size: np.searchsorted(-x, -size, side="left")  # items larger than size
    half = upto(capacity / 2)
    best = max(1, -(-int(total[-1]) // capacity), int(half))
    for t in np.unique(x[half:]).tolist():
        alone = upto(capacity - t)  # over capacity - t
        rest = int(np.searchsorted(-x, -t, side="right"))  # at least t
        open_ = int((half - alone) * capacity - (total[half] - total[alone]))
        best = max(best, int(half) + max(0, -(-(int(total[rest] - total[half]) - open_) // capacity)))
    return best


def fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, as few as differencing finds.

    The count starts at the lower bound; while a window is too full it rises, by steps that double, and once all fit it
    is halved back to the least count of those tried that fits. So a block costs a logarithm of tries, however many
    windows it needs. One item a window always fits.
    """
    if not len(sizes):
        return []

    def tried(ways: int) -> list[list[int]] | None:
        windows = differencing(sizes, ways)
        return windows if all(sizes[w].sum() <= capacity for w in windows) else None

    low, step = max(1, lower_bound(sizes, capacity)) - 1, 1  # low is known not to fit
    best = tried(low + 1)
    high = low + 1
    while best is None:
        low, high, step = high, min(len(sizes), high + step), step * 2
        best = tried(high) if high < len(sizes) else [[i] for i in range(len(sizes))]
    while high - low > 1:
        middle = (low + high) // 2
        got = tried(middle)
        low, high, best = (middle, high, best) if got is None else (low, middle, got)
    return best


def pack(sizes: DataFrame, row_id: str, size: str, capacity: int, block: int = 2_000) -> DataFrame:
    """(row_id, `piece`, `first`, `size`, `container`, `place`): each item's container and its place there.

    An item longer than the capacity is cut into pieces: full ones, each alone in its container, and a rest. `first`
    is where the piece begins in its item. All others go whole. Null and negative sizes count as 0; an item of size 0
    has a place too. Repeated rows are items of their own. An empty table gives no rows.

    Pieces are spread by hash over blocks of about `block` pieces, whatever their number; each block is one bounded
    task that packs by differencing. The waste is that of a block's last container, a part of about 1/(2 x containers
    in a block), alike at every size of the corpus.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.expr(f"(__n - 1) div {capacity}"), F.lit(0))
    pieces = sizes.select(F.col(row_id), n.alias("__n")).withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    pieces = pieces.select(
        row_id,
        "piece",
        (F.col("piece") * F.lit(capacity).cast("long")).alias("first"),
        F.least(F.col("__n") - F.col("piece") * F.lit(capacity).cast("long"), F.lit(capacity).cast("long")).alias("size"),
    )
    pieces = cut(pieces)
    blocks = max(1, round(pieces.count() / block))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", row_id, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        got = pdf["size"].to_numpy(dtype=np.int64)
        whole = np.nonzero(got == capacity)[0]
        rest = np.nonzero(got < capacity)[0]
        windows = [[i] for i in whole] + [list(rest[w]) for w in fill(got[rest], capacity)]
        where, place = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int32)
        for k, w in enumerate(windows):
            where[w], place[w] = k, np.arange(len(w))
        return pd.DataFrame({row_id: pdf[row_id], "piece": pdf["piece"], "first": pdf["first"], "size": got, "container": key[0] * (1 << 32) + where, "place": place})

    kind = dict(sizes.dtypes)[row_id]
    pieces = pieces.withColumn("__block", F.pmod(F.xxhash64(row_id, "piece"), F.lit(blocks)).cast("long"))
    # few bytes, but much work: blocks go to as many tasks as there are cores
    pieces = pieces.repartition(min(blocks, parallelism(sizes.sparkSession)), "__block")
    return pieces.groupBy("__block").applyInPandas(settle, f"{row_id} {kind}, piece int, first bigint, size bigint, container bigint, place int")
