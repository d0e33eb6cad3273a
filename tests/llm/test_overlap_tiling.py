"""Near overlap and leaked passages against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from trajecta.llm.overlap import FullTextIndex, distance, matches, overlap_counts, overlaps, spans
from trajecta.llm.tiling import leaked, rolling, tiles


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        b = list(a) if rng.random() < 0.7 else [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 4)] * rng.randint(0, 1)
        d = levenshtein(a, b)
        for most in (0, 2, 6, 30):
            assert distance(np.array(a, dtype=int), np.array(b, dtype=int), most) == (d if d <= most else None)


def test_full_text_index_counts_like_a_scan():
    rng = random.Random(2)
    texts = [np.array([rng.choice([-5, -1, 2, 3, 9]) for _ in range(rng.randint(1, 30))]) for _ in range(40)] + [np.array([7, 7, 7, 7])] * 2
    index = FullTextIndex(texts)
    for width in (1, 2, 4):
        patterns = np.array([[rng.choice([-5, -1, 2, 3, 9, 7, 100]) for _ in range(width)] for _ in range(60)])
        lo, hi = index.search(index.symbols(patterns.ravel()).reshape(patterns.shape))
        which, owner, place = index.places(lo, hi)
        for i, p in enumerate(patterns.tolist()):
            holds = lambda t: [k for k in range(len(t) - width + 1) if t[k : k + width].tolist() == p]
            assert hi[i] - lo[i] == sum(len(holds(t)) for t in texts) or (hi[i] <= lo[i] and not any(holds(t) for t in texts))
            own = which == i
            assert sorted(zip(owner[own].tolist(), place[own].tolist())) == [(k, x) for k, t in enumerate(texts) for x in holds(t)]
    assert FullTextIndex([]).n == 0


def gone(a, b):
    """Differing words of near texts."""
    d = levenshtein(a, b) if a and b else None
    return d if d is not None and d * 10 <= max(len(a), len(b)) else None


def test_matches_are_maximal_and_merged():
    rng = random.Random(6)
    for _ in range(60):
        base = [rng.randint(0, 60) for _ in range(rng.randint(20, 80))]
        texts = []
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randint(0, len(x) // 12)):
                x[rng.randrange(len(x))] = rng.randint(100, 200)
            texts.append(np.array(x))
        train = np.array(base)
        for t, d, words, n in matches(FullTextIndex(texts), texts, train):
            assert d == levenshtein(base, texts[t].tolist())
            # matched words at least those of all runs of seven and more equal words, which hold a slot wherever they lie
            same, least, run = train == texts[t], 0, 0
            for x in [*same.tolist(), False]:
                least, run = (least, run + 1) if x else (least + run * (run >= 7), 0)
            assert least <= words <= len(base) and 1 <= n <= d + 1
    assert spans(np.arange(20), np.concatenate([np.arange(8), [99], np.arange(9, 20)]), np.array([0, 12]), np.array([0, 12])) == [(0, 8), (9, 20)]


def varied(rng, words, n_edits):
    out = list(words)
    for _ in range(n_edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        out[at : at + (kind < 0.7)] = [] if kind < 0.3 else [f"new{rng.randint(0, 999)}"]
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    stock = [f"stock{i}" for i in range(25)]
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 9, 10, 12, 30, 60, 120]))] + (stock if rng.random() < 0.5 else []) for _ in range(30)]
    train, ev = [], []
    for i in range(160):
        b = rng.choice(base)
        train.append((i, " ".join(varied(rng, b, rng.randint(0, len(b) // 8)))))
    for i in range(60):
        b = rng.choice(base)
        ev.append((i, "  ".join(varied(rng, b, rng.randint(0, len(b) // 8))).upper() + " !?"))
    train += [(900, None), (901, ""), (902, " ... "), (903, train[0][1]), (903, train[0][1])]
    ev += [(900, None), (901, "?"), (902, train[0][1])]
    t = spark.createDataFrame(train, "tid long, said string").withColumn("__print", F.lit("clash"))
    e = spark.createDataFrame(ev, "eid long, said string").withColumn("tid_", F.lit(0))
    got = sorted((r["eid"], r["tid"], r["edits"]) for r in overlaps(t, e, "said", ["tid"], ["eid"]).collect())
    words = lambda x: [w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()]
    want = []
    for i, x in ev:
        for j, y in train:
            a, b = words(x), words(y)
            if a and b and (d := levenshtein(a, b)) * 10 <= max(len(a), len(b)):
                want.append((i, j, d))
    assert got == sorted(want) and len(want) > 100
    # the same from classes, without pairs
    t, e = t.withColumn("run", F.when(F.col("tid") % 3 > 0, F.col("tid") % 3)), e.withColumn("split", F.col("eid") % 2)
    counts = {(r["split"], r["run"]): tuple(r)[2:6] for r in overlap_counts(t, e, "said", "run", "split").collect()}
    rows = [((i % 2, j % 3 or None), i, k, d, j) for i, x in ev for k, (j, y) in enumerate(train) for d in [gone(words(x), words(y))] if d is not None]
    both = {g for g, *_ in rows}
    eval_rows = lambda g: len({(i, n) for n, (i, x) in enumerate(ev) for h, i2, *_ in rows if h == g and i2 == i})
    assert counts == {g: (sum(h == g for h, *_ in rows), sum(h == g and d == 0 for h, _, _, d, _ in rows), eval_rows(g), len({k for h, _, k, _, _ in rows if h == g})) for g in both}
    assert overlaps(t.limit(0), e, "said", ["tid"], ["eid"]).count() == 0
    assert overlaps(t, e.limit(0), "said", ["tid"], ["eid"]).count() == 0


def test_rolling_and_tiles():
    assert len(rolling(np.arange(3), 5)) == 0
    x = np.array([1, 2, 3, 4, 1, 2, 3])
    h = rolling(x, 3)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    # two parts in the other order are both covered, and no word twice
    passage = np.arange(1, 41)
    text = np.concatenate([passage[20:], [99], passage[:20], passage[:20]])
    got = tiles(text, passage, 12)
    assert sorted((p, n) for _, p, n in got) == [(0, 20), (20, 20)]
    assert tiles(passage[:11], passage, 12) == []
    assert tiles(np.ones(40, dtype=int), np.ones(30, dtype=int), 12) == [(0, 0, 30)]


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


@pytest.mark.parametrize("block", [300, 2_000_000])
def test_leaks_equal_brute_force(spark, block):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 40)}"
    passages = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 40])))) for i in range(12)] + [(12, None), (13, ""), (5, "w1 w2 w3")]
    records = []
    for i in range(80):
        fields = []
        for _ in range(rng.randint(0, 3)):
            w = [word() for _ in range(rng.randint(0, 40))]
            p = (rng.choice(passages)[1] or "").split()
            at = rng.randint(0, max(0, len(p) - 5))
            fields.append(rng.choice([None, " ".join(w), ", ".join(w + p[at : at + rng.randint(5, 25)] + w).upper()]))
        records.append(("k", i, fields))
    records += [("k", 900, None), ("k", 901, []), ("k", 0, records[0][2])]
    r = spark.createDataFrame(records, "kind string, rid long, texts array<string>").withColumn("__texts", F.lit(1)).withColumn("words", F.lit("clash"))
    p = spark.createDataFrame(passages, "pid long, said string")
    got = leaked(r, ["kind", "rid"], F.col("texts"), p, "pid", "said", coverage=2.0, block_bytes=block).collect()
    words = lambda x: "".join(c if c.isalnum() else " " for c in x.lower()).split()
    want = []
    for _, i, fields in records:
        for j, said in passages:
            runs = [longest_run(words(x), words(said or "")) for x in fields or [] if x]
            if max(runs, default=0) >= 12:
                want.append((j, i, max(runs)))
    assert sorted((x["pid"], x["rid"], x["longest"]) for x in got) == sorted(want) and want
    assert all(x["longest"] <= x["covered"] <= x["words"] for x in got)
    assert leaked(r.limit(0), ["rid"], F.col("texts"), p, "pid", "said").count() == 0
    assert leaked(r, ["rid"], F.col("texts"), p.limit(0), "pid", "said").count() == 0


def test_reordered_parts_count_by_coverage(spark):
    """Parts under twelve words in another order leak a passage if they cover enough of it; a stock phrase doesn't."""
    rng = random.Random(5)
    passage = [f"w{i}" for i in range(40)]
    parts = [passage[i : i + 8] for i in range(0, 40, 8)]
    texts = {}
    for i in range(30):
        picked = rng.sample(parts, rng.randint(0, 5))
        texts[i] = (picked, " ".join(" ".join(p) + f" x{rng.randint(0, 9)}" for p in picked))
    r = spark.createDataFrame([(i, [t, None]) for i, (_, t) in texts.items()], "rid long, texts array<string>")
    p = spark.createDataFrame([(1, " ".join(passage).replace("w3", "W3")), (2, "other words than those above, all of them, and quite a few of them too")], "pid long, said string")
    got = {(x["pid"], x["rid"]): (x["longest"], x["covered"]) for x in leaked(r, ["rid"], F.col("texts"), p, "pid", "said").collect()}
    assert got == {(1, i): (8, 8 * len(k)) for i, (k, _) in texts.items() if 8 * len(k) >= 20} and got
    with pytest.raises(ValueError, match="seed"):
        leaked(r, ["rid"], F.col("texts"), p, "pid", "said", least=4)
    # a script without blanks counts by characters, a passage of other white space by words
    chinese = "只有在重启之后才会出错尽管已被删除的最后一项又出现了"
    p = spark.createDataFrame([(1, chinese), (2, "\t".join(f"v{i}" for i in range(20)))], "pid long, said string")
    r = spark.createDataFrame([(1, [f"abc {chinese[5:18]} def"]), (2, ["\n".join(f"V{i}" for i in range(4, 17))]), (3, [chinese[:9]])], "rid long, texts array<string>")
    assert {(x["pid"], x["rid"], x["longest"]) for x in leaked(r, ["rid"], F.col("texts"), p, "pid", "said").collect()} == {(1, 1, 13), (2, 2, 13)}


def test_items_leaked_against_plain_counting(spark, sf):
    from trajecta.llm.queries import REG

    words = lambda x: "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()
    passages = [(r["heldout_id"], words(r["passage"])) for r in spark.read.parquet(f"{sf}/heldout_items.parquet").collect()]
    records = [("pair", r["pair_id"], [r["prompt"], r["chosen"], r["rejected"]]) for r in spark.read.parquet(f"{sf}/preference_pairs.parquet").collect()]
    records += [("sample", r["sample_id"], [m["content"] for m in r["messages"] or []]) for r in spark.read.parquet(f"{sf}/sft_samples.parquet").collect()]
    runs = {}
    for i, w in passages:
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for kind, i, fields in records:
        for f in fields:
            w = words(f)
            for k in range(len(w) - 11):
                want |= {(h, kind, i) for h in runs.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in REG.queries["p4_found"](spark, sf).collect()} == want and want
    got = {(r["heldout_id"], r["record_kind"]): (r["records"] - r["in_parts"]) for r in REG.queries["p4_items"](spark, sf).collect()}
    assert {k: n for k, n in got.items() if n} == {(h, kind): sum((a, b) == (h, kind) for a, b, _ in want) for h, kind, _ in want}
