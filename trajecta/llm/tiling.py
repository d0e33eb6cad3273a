"""Problem 4: evaluation passages inside training text, by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.session import spread

#: A word; a character of a script without blanks is one by itself.
WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values (mod 2^64) of all windows of `width` numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    x, out = ids.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _BASE + x[k : k + n]
    return out


def tiles(text: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in text, place in passage, words) of the tiles of greedy string tiling, longest first.

    Rounds: Karp-Rabin windows of `least` unmarked words that occur on both sides are extended as far as both stay
    equal and unmarked; the longest matches are marked, those of a round that overlap a marked one wait for the next.
    No word is in two tiles, and their order in text and passage may differ. Ties go to the first place in the text,
    then in the passage.
    """
    free_t, free_p, out = np.ones(len(text), dtype=bool), np.ones(len(passage), dtype=bool), []
    seeds: dict[int, list[int]] = {}
    for j, h in enumerate(rolling(passage, least).tolist()):
        seeds.setdefault(h, []).append(j)
    starts = [(i, h) for i, h in enumerate(rolling(text, least).tolist()) if h in seeds]
    while starts:
        found = []
        for i, h in starts:
            for j in seeds[h]:
                if i and j and free_t[i - 1] and free_p[j - 1] and text[i - 1] == passage[j - 1]:
                    continue  # not the left end of its match
                n = min(len(text) - i, len(passage) - j)
                bad = np.nonzero((text[i : i + n] != passage[j : j + n]) | ~free_t[i : i + n] | ~free_p[j : j + n])[0]
                size = int(bad[0]) if len(bad) else n
                if size >= least:
                    found.append((-size, i, j))
        marked = 0
        for size, i, j in sorted(found):
            if free_t[i : i - size].all() and free_p[j : j - size].all():
                free_t[i : i - size] = free_p[j : j - size] = False
                out.append((i, j, -size))
                marked += 1
        if not marked:
            break
        starts = [(i, h) for i, h in starts if free_t[i : i + least].all()]
    return out


class Index:
    """A block of passages: word numbers, and where each window of `seed` words occurs."""

    def __init__(self, passages: Sequence[tuple[int, str]], least: int, seed: int, coverage: float) -> None:
        self.least, self.seed, self.coverage, self.numbers = least, seed, coverage, {}
        self.ids, self.words = [], []
        for key, text in passages:
            self.ids.append(key)
            self.words.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORD.findall(text.lower())], dtype=np.int64))
        hashes = [rolling(w, seed) for w in self.words]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        both = np.concatenate([*hashes, np.empty(0, dtype=np.uint64)])
        order = np.argsort(both, kind="stable")
        self.hashes, self.owner = both[order], owner[order]

    def find(self, texts: Sequence[Sequence[str | None]]) -> list[tuple[int, int, int, int]]:
        """(record, passage, longest tile, words of the passage covered by one text at best) of a batch of records, where either is enough."""
        get, flat, row, start = self.numbers.get, [], [], [0]
        for r, fields in enumerate(texts):
            for t in fields if fields is not None else ():
                if t:
                    flat += [get(w, 0) for w in WORD.findall(t.lower())]
                    row.append(r)
                    start.append(len(flat))
        ids, ends = np.array(flat, dtype=np.int64), np.array(start)
        hashes = rolling(ids, self.seed)
        at = np.searchsorted(self.hashes, hashes)
        hit = np.nonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes)[0] if len(self.hashes) else np.empty(0, dtype=int)
        field = np.searchsorted(ends, hit, side="right") - 1
        inside = hit + self.seed <= ends[np.minimum(field + 1, len(ends) - 1)]
        seeds: dict[tuple[int, int], int] = {}
        for h, f in zip(hit[inside].tolist(), field[inside].tolist()):
            k = int(at[h])
            while k < len(self.hashes) and self.hashes[k] == hashes[h]:
                seeds[f, int(self.owner[k])] = seeds.get((f, int(self.owner[k])), 0) + 1
                k += 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (f, p), n in seeds.items():
            # a tile of `least` words has so many seeds, and n seeds cover at most n times their words
            if n <= self.least - self.seed and n * self.seed < self.coverage * len(self.words[p]):
                continue
            got = tiles(ids[ends[f] : ends[f + 1]], self.words[p], self.seed)
            if got:
                old = best.get((row[f], p), (0, 0))
                best[row[f], p] = max(old[0], got[0][2]), max(old[1], sum(x[2] for x in got))
        return [(r, p, *best[r, p]) for r, p in sorted(best) if best[r, p][0] >= self.least or best[r, p][1] >= self.coverage * len(self.words[p])]


_INDEX: dict[str, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast block, built once in a worker."""
    name, passages, *rest = shared.value
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(passages, *rest)
    return _INDEX[name]


def leaked(
    records: DataFrame, keys: Sequence[str], texts: Column, passages: DataFrame, passage_id: str, passage: str, least: int = 12, seed: int = 6, coverage: float = 0.5, block_bytes: int = 1 << 25
) -> DataFrame:
    """(passage_id, *keys, `longest`, `covered`, `words`): records one of whose texts holds a passage or a good part of it.

    texts is an array of strings of a record; words are runs of letters and digits, letter case aside (characters, in a
    script without blanks), and tiles have at least `seed` of them. A record leaks a passage if its longest tile has
    `least` words, or if the tiles of one text cover the share `coverage` of the passage, in whatever order its parts
    stand there. `longest` is the longest tile, `covered` the most words that tiles of one text cover, `words` the
    passage's length.

    The passages are the stated query set: they travel with the tasks in blocks of at most block_bytes of text (a
    single longer passage is a block), counted as they stream through the driver, which keeps none of them; workers
    index a block once. Each block is one scan of the records, and no record is shuffled. Null texts and passages, and
    passages under `seed` words, match nothing; repeated records and passages each count; empty tables give no rows.
    """
    if not 1 <= seed <= least:
        raise ValueError("seed must be from 1 to least")
    kinds, schema = dict(records.dtypes), f"{passage_id} {dict(passages.dtypes)[passage_id]}, "
    schema += ", ".join(f"{k} {kinds[k]}" for k in keys) + ", longest int, covered int, words int"
    slim = spread(records.select(*keys, texts.alias("__texts")))

    def scan(block: list[tuple]) -> DataFrame:
        shared = records.sparkSession.sparkContext.broadcast((uuid4().hex, block, least, seed, coverage))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shared)
            for b in batches:
                got = index.find(b["__texts"].tolist())
                rows = [x[0] for x in got]
                out = {passage_id: [index.ids[x[1]] for x in got]} | {k: b[k].to_numpy()[rows] for k in keys}
                yield pd.DataFrame(out | {"longest": [x[2] for x in got], "covered": [x[3] for x in got], "words": [len(index.words[x[1]]) for x in got]})

        return slim.mapInPandas(run, schema)

    found, block, size = None, [], 0
    wanted = passages.select(passage_id, passage).filter(F.col(passage).isNotNull()).orderBy(passage_id, passage)
    for row in wanted.toLocalIterator():
        n = len(row[1].encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            part = scan(block)
            found, block, size = (part if found is None else found.union(part)), [], 0
        block.append((row[0], row[1]))
        size += n
    part = scan(block)
    return part if found is None else found.union(part)
