"""Splits, containers and token ids: invariants and brute force."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm.packing import differencing, fill, lower_bound, pack
from trajecta.llm.splits import components, contract, place, spelling_pairs, stratified_splits
from trajecta.llm.tokens import TOKENIZERS, VOCABULARY, close, decode, encode, encode_corpus, encoder, join, leaf

PARTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def union_find(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, *keys in rows:
        keys = [(i, k) for i, k in enumerate(keys) if k is not None]
        for a, b in zip(keys, keys[1:]):
            root[find(a)] = find(b)
    groups = defaultdict(set)
    for i, *keys in rows:
        keys = [(n, k) for n, k in enumerate(keys) if k is not None]
        groups[find(keys[0]) if keys else ("own", i)].add(i)
    return {frozenset(g) for g in groups.values()}


def test_components_over_two_keys(spark):
    rng = random.Random(1)
    pick = lambda n: rng.choice([None, *map(str, range(n))])
    rows = [(i, pick(90), pick(70)) for i in range(120)] + [(1000 + i, f"c{i}", f"c{i + 1}") for i in range(30)] + [(2000 + i, f"c{i + 1}", f"c{i}") for i in range(30)]
    got = components(spark.createDataFrame(rows, "id long, a string, b string"), "id", [F.col("a"), F.col("b")]).collect()
    by = defaultdict(set)
    for r in got:
        by[r["component"]].add(r["id"])
    assert {frozenset(g) for g in by.values()} == union_find(rows) and len(got) == len(rows)


def test_contract_a_long_chain_and_nothing(spark):
    edges = spark.createDataFrame([(f"{i + 1:03}", f"{i:03}") for i in range(100)], "a string, b string")
    got = {r["node"]: r["root"] for r in contract(edges).collect()}
    assert got == {f"{i:03}": "000" for i in range(1, 101)}
    assert contract(edges.limit(0)).count() == 0


def test_place_serves_rare_labels_first():
    vectors = np.array([[10, 0], [10, 0], [0, 1], [0, 1]])
    want = np.array([[10.0, 10.0], [1.0, 1.0]])
    got = place(vectors, ["a", "b", "c", "d"], want)
    assert sorted(got[:2]) == [0, 1] and sorted(got[2:]) == [0, 1]


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 300 + [None] * 20 + [f"k{rng.randint(0, 400)}" for _ in range(900)]), rng.choice("xxxxyz")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, who string, label string").withColumn("split", F.lit("clash")).withColumn("component", F.lit(1))
    got = {r["id"]: (r["component"], r["split"]) for r in stratified_splits(df, "id", [F.col("who")], F.col("label"), {"train": 0.6, "validation": 0.2, "test": 0.2}, block=100).collect()}
    assert len(got) == len(rows)
    of = defaultdict(set)
    for i, who, _ in rows:
        of[who if who is not None else ("own", i)].add(got[i][1])
    assert all(len(s) == 1 for s in of.values())
    for label in "xyz":
        n = Counter(got[i][1] for i, _, y in rows if y == label)
        assert abs(n["train"] / sum(n.values()) - 0.6) < 0.05 and abs(n["test"] / sum(n.values()) - 0.2) < 0.05


def test_splits_over_two_keys_and_edges(spark):
    rows = [(1, "a", "s"), (2, "b", "s"), (3, "b", None), (4, None, None), (5, None, "t"), (6, "c", "t")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r["id"]: r["split"] for r in stratified_splits(df, "id", [F.col("a"), F.col("b")], F.lit(None), PARTS).collect()}
    assert len(got) == 6 and got[1] == got[2] == got[3] and got[5] == got[6]
    assert stratified_splits(df.limit(0), "id", [F.col("a")], F.col("b"), PARTS).count() == 0
    with pytest.raises(ValueError, match="labels"):
        stratified_splits(df, "id", [F.col("a")], F.col("id"), PARTS, max_labels=3)


def test_spelling_pairs(spark):
    df = spark.createDataFrame([("a",), ("A",), ("A",), (" a",), ("b",), (None,)], "x string").withColumn("s", F.lit(1))
    got = {(r["a"], r["b"]) for r in spelling_pairs(df, "x", F.lower(F.trim("x"))).collect()}
    assert got == {(" a", "A"), (" a", "a"), ("A", "a")}


def test_differencing_covers_all_and_balances():
    rng = random.Random(6)
    for n, ways in ((1, 3), (7, 2), (60, 5), (400, 37)):
        sizes = np.array([rng.choice([1, 5, 30, 200]) for _ in range(n)])
        got = differencing(sizes, ways)
        assert sorted(i for w in got for i in w) == list(range(n)) and len(got) <= ways
    sums = [sizes[w].sum() for w in got]
    assert max(sums) - min(sums) <= 200
    assert differencing(np.array([], dtype=np.int64), 3) == []
    # by hand: 8 7 | 6 5 4 is even
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in differencing(np.array([8, 7, 6, 5, 4]), 2)) in ([14, 16], [15, 15])
    assert all(sum(w) <= 10 for w in [[[6, 6, 6][i] for i in x] for x in fill(np.array([6, 6, 6]), 10)])


def least_windows(sizes, capacity):
    """The fewest windows, by trying all ways."""
    best = [len(sizes)]

    def go(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity:
                loads[k] += sizes[i]
                go(i + 1, loads)
                loads[k] -= sizes[i]
        go(i + 1, [*loads, sizes[i]])

    go(0, [])
    return best[0]


def test_fill_against_the_fewest_windows():
    rng = random.Random(9)
    for _ in range(150):
        sizes = np.array([rng.randint(1, 10) for _ in range(rng.randint(1, 8))])
        got = fill(sizes, 10)
        assert sorted(i for w in got for i in w) == list(range(len(sizes))) and all(sizes[w].sum() <= 10 for w in got)
        least = least_windows(sizes.tolist(), 10)
        assert lower_bound(sizes, 10) <= least <= len(got) <= least + 1
    assert fill(np.array([], dtype=np.int64), 10) == [] and fill(np.zeros(3, dtype=np.int64), 10) == [[0, 1, 2]]


@pytest.mark.parametrize("kind", ["over half", "mixed", "small"])
def test_a_block_costs_few_tries_and_wastes_little(kind):
    rng = np.random.default_rng(1)
    sizes = {"over half": rng.integers(4_100, 4_300, 2_000), "mixed": np.minimum(8_191, np.exp(rng.normal(5.5, 1.2, 2_000)).astype(int) + 1), "small": rng.integers(1, 900, 2_000)}[kind]
    began = time.process_time()
    got = fill(sizes, 8_192)
    assert time.process_time() - began < 5
    assert len(got) <= 1.02 * lower_bound(sizes, 8_192) and all(sizes[w].sum() <= 8_192 for w in got)


def test_containers_of_the_corpus_waste_little(spark, sf):
    """At most 2 % and one container over the least that the tokens need."""
    sizes = encode_corpus(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", lengths=True)
    got = pack(sizes, "doc_id", "n_tokens", 1_024).collect()
    assert len({r["container"] for r in got}) <= 1.02 * sum(r["size"] for r in got) / 1_024 + 1


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 3, 10, 50, 99, 100, 101, 350])) for i in range(400)] + [(400, None), (401, -5), (402, 100_000)] + [(0, 7)]
    df = spark.createDataFrame(rows, "id long, n long").withColumn("size", F.lit("clash")).withColumn("container", F.lit(0))
    got = pack(df, "id", "n", 100, block=50).collect()
    fill_of, places = Counter(), defaultdict(list)
    for r in got:
        fill_of[r["container"]] += r["size"]
        places[r["container"]].append(r["place"])
    assert max(fill_of.values()) <= 100
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    total = sum(max(0, n or 0) for _, n in rows)
    assert sum(r["size"] for r in got) == total and total / 100 / len(fill_of) > 0.8
    pieces = sorted((r["first"], r["size"]) for r in got if r["id"] == 402)
    assert len(pieces) == 1000 and [f for f, _ in pieces] == list(range(0, 100_000, 100))
    assert Counter(r["id"] for r in got if r["first"] == 0)[0] == 2
    assert all(len([r for r in got if r["id"] == i]) == 1 for i, n in rows if i and (n or 0) <= 100)
    assert pack(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack(df, "id", "n", 0)


needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(f"{TOKENIZERS}/{VOCABULARY}.tiktoken"), reason="no vocabulary here")


@needs_vocabulary
def test_monoid_equals_the_tokenizer():
    enc, rng = encoder(TOKENIZERS, VOCABULARY), random.Random(8)
    letters = " \n\t\r'slvre'  a1é中!.ßd　​\x1c\x85"
    for n in range(8000):
        if n == 4000:  # texts without blanks
            letters = "中文テ、。，…!'s9a・·가é²Ⅷ1"
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert encode(x, enc, rng.randint(1, 7)).tolist() == enc.encode_ordinary(x)
        cut = sorted(rng.sample(range(len(x) + 1), min(2, len(x) + 1)))
        a, b, c = (leaf(s, enc) for s in (x[: cut[0]], x[cut[0] : cut[-1]], x[cut[-1] :]))
        # associative
        left, right = join(join(a, b, enc), c, enc), join(a, join(b, c, enc), enc)
        assert close(left, enc).tolist() == close(right, enc).tolist() == enc.encode_ordinary(x)
        assert decode([close(left, enc)], enc) == x
    # a long text without blanks has settled ids almost everywhere
    text = "重启之后错误的顺序又出现了，尽管旧令牌已被删除。" * 200
    piece = leaf(text, enc)
    assert len(piece.head) < 30 and len(piece.tail) < 30 and encode(text, enc, 64).tolist() == enc.encode_ordinary(text)


@needs_vocabulary
def test_corpus_round_trip(spark):
    enc = encoder(TOKENIZERS, VOCABULARY)
    texts = ["", None, " ", "x", "<|endoftext|> a", "word " * 5000, "y" * 3000, "中文 テスト\r\n" * 700, "á ퟿", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, "same")], "id long, t string").withColumn("ids", F.lit("clash"))
    for chunk in (1 << 18, 1000, 256):
        got = defaultdict(list)
        for r in encode_corpus(df, "id", "t", width=64, chunk=chunk).collect():
            got[r["id"]].append(list(r["ids"]))
        for i, t in enumerate(texts):
            assert got[i][0] == enc.encode_ordinary(t or "")
            assert decode([np.array(got[i][0], dtype=np.int32)], enc) == (t or "")
        assert len(got[9]) == 2
        n = {r["id"]: r["n_tokens"] for r in encode_corpus(df, "id", "t", lengths=True, chunk=chunk).collect()}
        assert n == {i: len(x[0]) for i, x in got.items()}
    assert encode_corpus(df.limit(0), "id", "t").count() == 0


def test_splits_of_the_tables(spark, sf):
    """p5_splits: one split for a component, every record once, labels near their proportions."""
    from trajecta.llm.queries import PROPORTIONS, REG, _records

    got = {r["record"]: r for r in REG.queries["p5_splits"](spark, sf).collect()}
    rows = _records(spark, sf).collect()
    assert len(got) == len(rows) == len({r["record"] for r in rows})
    of = defaultdict(set)
    for r in got.values():
        of[r["component"]].add(r["split"])
    assert all(len(x) == 1 for x in of.values())
    sizes, labels = Counter(r["component"] for r in got.values()), defaultdict(Counter)
    for r in rows:
        labels[r["label"]][got[r["record"]]["split"]] += 1
    for label, n in labels.items():
        # whole components move, so that a label is off by one of its components at most, and by what others' needs cost
        largest = max(Counter(got[r["record"]]["component"] for r in rows if r["label"] == label).values())
        for split, share in PROPORTIONS.items():
            assert abs(n[split] - share * n.total()) <= largest + 0.1 * n.total() + 2, (label, n)
    assert max(sizes.values()) > 1
