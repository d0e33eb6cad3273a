"""Problem 3: the same or nearly the same record in two splits, by a full-text index of evaluation shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.session import cut, parallelism, spread

#: Words in a slot, and how many rare slots of a text an evaluation text must hold to be looked at (see `near`).
SLOT, AT_LEAST = 4, 3
#: One word in TEN may differ.
TEN = 10


class FullTextIndex:
    """FM-index over a shard of texts given as word numbers.

    Holds the suffix array (for locating), the first row of each symbol, and for each symbol the sorted rows where the
    Burrows-Wheeler transform has it, from which a rank is one binary search. Each text ends in a separator.
    """

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        self.begin = np.cumsum(lengths) - lengths
        ends, n = np.cumsum(lengths) - 1, int(lengths.sum())
        self.alphabet, symbols = np.unique(np.concatenate([*texts, np.zeros(0, dtype=np.int64)]), return_inverse=True)
        coded = np.zeros(n, dtype=np.int64)  # symbol 0 is the separator
        coded[np.setdiff1d(np.arange(n), ends, assume_unique=True)] = symbols + 1
        # separators compare by place, so that all suffixes differ
        rank = coded + len(texts)
        rank[ends] = np.arange(len(texts))
        step = 1
        while True:
            second = np.full(n, -1, dtype=np.int64)
            second[:-step or n] = rank[step:] if step < n else []
            key = rank * (n + len(texts) + 2) + second + 1
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if n else []
            rank, step = fresh, step * 2
            if n == 0 or rank.max() == n - 1:
                break
        self.sa = order.astype(np.int32)  # a shard is small, so that four bytes do
        bwt = coded[self.sa - 1]  # of the first suffix it is the last separator
        self.first = np.searchsorted(np.sort(coded), np.arange(len(self.alphabet) + 2))
        rows = np.argsort(bwt, kind="stable")
        self.n, self.keys = n, bwt[rows] * (n + 1) + rows

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol numbers, -1 for words that the shard lacks."""
        if not len(self.alphabet):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def _rank(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, c * (self.n + 1) + row) - self.first[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of equally long patterns (rows of symbols): backward search, all patterns a word at a time."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.nonzero((patterns >= 0).all(axis=1))[0]
        hi[np.setdiff1d(np.arange(len(patterns)), live, assume_unique=True)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.first[c] + self._rank(c, lo[live])
            hi[live] = self.first[c] + self._rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, text, place in text) of all occurrences."""
        n = np.maximum(hi - lo, 0)
        pattern = np.repeat(np.arange(len(lo)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = self.sa[row]
        text = self.owner[at]
        return pattern, text, at - self.begin[text]


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Words added, removed or replaced between a and b, None beyond `most`: furthest reaching points by diagonal."""
    if abs(len(a) - len(b)) > most:
        return None
    n, m, runs = len(a), len(b), {}

    def far(d: int, i: int) -> int:
        """The first i' >= i where a[i'] and b[i' + d] differ or one ends."""
        if d not in runs:
            lo, hi = max(0, -d), min(n, m - d)
            runs[d] = lo, hi, lo + np.nonzero(a[lo:hi] != b[lo + d : hi + d])[0]
        lo, hi, bad = runs[d]
        k = np.searchsorted(bad, i)
        return int(bad[k]) if k < len(bad) else hi

    reach = {0: far(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        after = {}
        for d in range(max(-e - 1, -n), min(e + 1, m) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i >= 0 and i + d >= 0:
                after[d] = far(d, i)
        reach = after
    return None


def spans(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[tuple[int, int]]:
    """The maximal matches of a and b around places that match (at_a in a, at_b in b), merged to spans [from, to) of a."""
    found = []
    for d in np.unique(at_b - at_a).tolist():
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        bad = lo + np.nonzero(a[lo:hi] != b[lo + d : hi + d])[0]
        k = np.searchsorted(bad, np.unique(at_a[at_b - at_a == d]))
        found += zip(np.concatenate([[lo], bad + 1])[k].tolist(), np.concatenate([bad, [hi]])[k].tolist())
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(found)):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def matches(index: FullTextIndex, texts: list[np.ndarray], train: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, differing words, words in matched spans, spans) for the texts of the shard that are near train.

    Disjoint slots of train go through backward search together. d differing words spoil at most d slots, so a near text
    holds all other slots exactly. Where a text has enough of them, each is extended to the maximal match that it lies
    in, the matches are merged to spans of train and counted, and the words between decide. Nothing near is lost.
    """
    n = len(train)
    s = n // SLOT
    if not s:
        return []
    lo, hi = index.search(index.symbols(train[: s * SLOT]).reshape(s, SLOT))
    pattern, text, place = index.places(lo, hi)
    slots = np.unique(text * np.int64(s) + pattern) // s
    which, count = np.unique(slots, return_counts=True)
    out = []
    for t, c in zip(which.tolist(), count.tolist()):
        other = texts[t]
        most = max(n, len(other)) // TEN
        if c >= s - most and (d := distance(train, other, most)) is not None:
            own = text == t
            merged = spans(train, other, pattern[own] * SLOT, place[own])
            out.append((t, d, sum(y - x for x, y in merged), len(merged)))
    return out


def near(train: DataFrame, evaluation: DataFrame, key: str, text: str, shard: int = 256, block: int = 4_096) -> DataFrame:
    """(`train_print`, `eval_print`, `edits`, `words`, `spans`) of near texts.

    train and evaluation hold distinct texts with key (the print) and text (words with single blanks).

    A train text of n words may differ from an evaluation text in at most e = n // 9 words, and its s = n // 4 disjoint
    slots of four words are spoilt one a word at most: s - e of them at least occur there unchanged. Slots are joined with
    the counts of all evaluation grams. A text of whose slots fewer than s - e occur at all leads nowhere; else, of its
    slots that occur, all but s - e - 3 are looked up, the rarest, and of these the text sought holds three at least
    (fewer, where s - e is less). So it is found, and hot grams (stock phrases) are hardly ever looked up; where they are,
    nothing is capped. What has three of them, and a fitting length, leads to its shard of `shard` evaluation texts; in each shard visited a
    full-text index is built, the visitors stream through it, and its matches are verified (`matches`). A shard with
    many visitors is built in several tasks of `block` visitors.
    """
    kind = dict(train.dtypes)[key]
    grams = lambda starts: F.transform(starts, lambda i: F.xxhash64(F.slice("__said", i, SLOT)))
    n = F.size("__said")
    shards = F.pmod(F.xxhash64(key), F.lit(max(1, -(-evaluation.count() // shard)))).cast("int")
    # numbers that a checkpoint's partitions fix
    ev = evaluation.withColumn("__shard", shards).withColumn("__e", F.monotonically_increasing_id())
    train = train.withColumn("__t", F.monotonically_increasing_id())
    told = ev.select("__e", F.split(text, " ").alias("__said")).filter(n >= SLOT)
    posted = told.select("__e", n.cast("int").alias("__m"), F.explode(F.array_distinct(grams(F.sequence(F.lit(1), n - (SLOT - 1))))).alias("__gram"))
    posted = posted.repartition(parallelism(train.sparkSession), "__gram")
    counts = posted.groupBy("__gram").agg(F.count("*").cast("int").alias("__n"))
    heard = train.select("__t", F.split(text, " ").alias("__said")).filter(n >= TEN - 1)
    slots = heard.select("__t", n.alias("__len"), F.explode(grams(F.sequence(F.lit(1), n - (SLOT - 1), F.lit(SLOT)))).alias("__gram"))
    known = slots.join(counts, "__gram").groupBy("__t").agg(F.first("__len").alias("__len"), F.array_sort(F.collect_list(F.struct("__n", "__gram"))).alias("__known"))
    known = known.withColumn("__sure", F.expr(f"cast(__len div {SLOT} - __len div {TEN - 1} as int)")).filter(F.size("__known") >= F.col("__sure"))
    known = known.withColumn("__least", F.least(F.col("__sure"), F.lit(AT_LEAST)))
    led = known.select("__t", "__len", "__least", F.explode(F.slice("__known", F.lit(1), F.size("__known") - F.col("__sure") + F.col("__least"))).alias("__k"))
    led = led.select("__t", "__len", "__least", F.col("__k.__gram").alias("__gram"))
    fits = F.abs(F.col("__len") - F.col("__m")) * TEN <= F.greatest("__len", "__m")
    close = led.join(posted, "__gram").filter(fits).groupBy("__t", "__e").agg(F.count("*").alias("__n"), F.first("__least").alias("__least")).filter("__n >= __least")
    visits = close.select("__t", "__e").join(ev.select("__e", "__shard"), "__e").select("__t", "__shard").distinct()
    visits = cut(visits.join(train.select("__t", key), "__t").select(key, "__shard"))
    crowd = visits.groupBy("__shard").agg(F.count("*").alias("__visits")).withColumn("__blocks", F.expr(f"cast((__visits - 1) div {block} + 1 as int)"))
    guests = visits.join(train, key).join(crowd, "__shard").withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"))
    hosts = ev.join(crowd, "__shard").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    guests, hosts = (x.select("__shard", "__block", F.col(key).alias("__key"), F.col(text).alias("__text")) for x in (guests, hosts))

    def stream(visitors: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(visitors) and len(texts):
            number: dict[str, int] = {}
            held = [np.array([number.setdefault(w, len(number) + 1) for w in x.split(" ")], dtype=np.int64) for x in texts["__text"]]
            names, index = texts["__key"].tolist(), FullTextIndex(held)
            for name, said in zip(visitors["__key"], visitors["__text"]):
                words = np.array([number.get(w, -1) for w in said.split(" ")], dtype=np.int64)
                rows += [(name, names[t], *found) for t, *found in matches(index, held, words) if names[t] != name]
        return pd.DataFrame(rows, columns=["train_print", "eval_print", "edits", "words", "spans"])

    together = guests.groupBy("__shard", "__block").cogroup(hosts.groupBy("__shard", "__block"))
    return together.applyInPandas(stream, f"train_print {kind}, eval_print {kind}, edits int, words int, spans int")


def printed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """*keep, `__print` (128 bits over the words) and `__text` (words, single blanks); wordless texts are left out."""
    df = spread(df.select(*keep, F.col(text).alias(text))).select(*keep, F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")).alias("__text")).filter("__text <> ''")
    return df.select(*keep, F.unhex(F.md5(F.col("__text").cast("binary"))).alias("__print"), "__text")


def linked(train: DataFrame, evaluation: DataFrame, text: str, train_keys: list[str], eval_keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal texts, and the links between them: (links, train members, evaluation members).

    links: (`train_print`, `eval_print`, `edits`, `words`, `spans`): near texts, how many words differ, how many of the
    train text lie in maximal matches, and in how many spans. Members: (`train_print`, *train_keys) and (`eval_print`,
    *eval_keys), a row for each row with a word. Copies are never expanded into pairs here.
    """
    rows = [cut(printed(x, text, *keys)) for x, keys in ((train, train_keys), (evaluation, eval_keys))]
    one = [cut(x.groupBy("__print").agg(F.first("__text").alias("__text"))) for x in rows]
    close = near(one[0], one[1], "__print", "__text")
    length = F.size(F.split("__text", " "))
    same = one[0].select("__print", length.alias("words")).join(one[1].select("__print"), "__print")
    same = same.select(F.col("__print").alias("train_print"), F.col("__print").alias("eval_print"), F.lit(0).alias("edits"), "words", F.lit(1).alias("spans"))
    return cut(close.union(same)), rows[0].select(F.col("__print").alias("train_print"), *train_keys), rows[1].select(F.col("__print").alias("eval_print"), *eval_keys)


def overlaps(train: DataFrame, evaluation: DataFrame, text: str, train_keys: list[str], eval_keys: list[str]) -> DataFrame:
    """(*eval_keys, *train_keys, `edits`): evaluation rows and the train rows that differ in at most one word in ten.

    Words are runs of letters and digits, letter case aside; added, removed and replaced words count against the longer
    text. Each distinct text is compared once, however many rows share it (`linked`); the rows come back by joins on the
    prints, which AQE may split where a print is hot. Null texts and texts without a word overlap nothing. Repeated rows
    each count. Empty tables give no rows. Key columns of the two sides must differ in name.
    """
    links, t, e = linked(train, evaluation, text, train_keys, eval_keys)
    return links.select("train_print", "eval_print", "edits").join(e, "eval_print").join(t, "train_print").select(*eval_keys, *train_keys, "edits")


def overlap_counts(train: DataFrame, evaluation: DataFrame, text: str, source: str, split: str) -> DataFrame:
    """(split, source, `links`, `exact_links`, `eval_rows`, `train_rows`, `matched_words`): overlaps of each split and source.

    source is a column of train, split one of evaluation. Counted from the links of classes and the classes' sizes, so
    that no pair of copies is ever built. matched_words counts words of train texts in maximal matches, a link at a time.
    """
    links, t, e = linked(train, evaluation, text, [source], [split])
    t, e = (x.groupBy(*x.columns).agg(F.count("*").alias(n)) for x, n in ((t, "__t"), (e, "__e")))
    met = cut(links.join(e, "eval_print").join(t, "train_print"))
    by, both = [split, source], F.col("__e") * F.col("__t")
    total = met.groupBy(*by).agg(F.sum(both).alias("links"), F.sum(F.when(F.col("edits") == 0, both).otherwise(0)).alias("exact_links"), F.sum(both * F.col("words")).alias("matched_words"))
    sides = [met.select(*by, p, n).distinct().groupBy(*by).agg(F.sum(n).alias(name)) for p, n, name in (("eval_print", "__e", "eval_rows"), ("train_print", "__t", "train_rows"))]
    for side in sides:
        total = total.alias("x").join(side.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]).select("x.*", F.col("y." + side.columns[-1]))
    return total.select(*by, "links", "exact_links", "eval_rows", "train_rows", "matched_words")
