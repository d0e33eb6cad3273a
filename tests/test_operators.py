"""Operators against plain loops on random and crafted tables."""

import itertools
import random
from collections import defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from trajecta.operators import hooks, intervals, joins, ledger, metrics, pairs, prep, streaks, turns


def test_cards_equal_a_loop(spark):
    rng = random.Random(1)
    said = ["HYPOTHESIS: a", "HYPOTHESIS: a", "HYPOTHESIS: b", "HYPOTHESIS: <one sentence>", "thinking"]
    fed = ["guidance round 1", "tests FAILED. Reconsider your current HYPOTHESIS", "out", "HYPOTHESIS: no"]
    rows = []
    for log in range(120):
        for i in range(rng.randint(0, 14)):
            who = rng.choice(["assistant", "user"])
            rows.append((log, i, who, rng.choice(said if who == "assistant" else fed)))
    want, state = {}, {}
    for log, i, who, text in rows:
        hyp, pending, card = state.get(log, (None, None, 0))
        opened = None
        if who == "user":
            if "guidance round" in text:
                pending = "oracle"
            elif "FAILED" in text:
                pending = "self_rescue"
        elif text.startswith("HYPOTHESIS: ") and "<" not in text:
            h = text[12:]
            if h != hyp or pending:
                card, opened = card + 1, pending or "explore"
            hyp, pending = h, None
        state[log] = hyp, pending, card
        want[log, i] = (card, opened)
    df = spark.createDataFrame(rows, "log int, idx int, role string, text string").repartition(3)
    got = {(r["log"], r["idx"]): (r["card"], r["opened_by"]) for r in ledger.card_openings(df, ["log"]).collect()}
    assert got == want


def test_evidence_never_sees_its_own_card(spark):
    rng = random.Random(9)
    items = [(log, rng.randint(0, 20), i, f"i{rng.randint(0, 40)}") for log in range(8) for i in range(90)] + [(0, c, 0, f"canary{c}") for c in range(20)]
    nodes = [(log, c, "x") for log in range(9) for c in range(20)]
    n_df = spark.createDataFrame(nodes, "log int, card int, hyp string").repartition(3)
    i_df = spark.createDataFrame(items, "log int, card int, idx int, item string").repartition(3)
    for distinct in (True, False):
        got = {(r["log"], r["card"]): r["prior"] for r in ledger.last_before(n_df, i_df, ["log"], "card", "item", "idx", 12, distinct).collect()}
        assert len(got) == len(nodes)
        for log, c, _ in nodes:
            seen = [x for _, _, x in sorted((k, i, x) for l, k, i, x in items if l == log and k < c)]
            assert got[log, c] == (list(dict.fromkeys(seen)) if distinct else seen)[-12:]
            assert f"canary{c}" not in got[log, c]


def test_actions_and_results(spark):
    rows = [(1, 0, "assistant", ["a", "b", "c"], ""), (1, 1, "user", None, "A"), (1, 2, "user", None, "B"), (1, 3, "assistant", ["d"], ""), (1, 4, "user", None, "D"), (1, 5, "user", None, "E")]
    df = spark.createDataFrame(rows, "log int, idx int, role string, actions array<string>, text string")
    got = {r["action"]: r["observation"] for r in ledger.pair_actions(df, ["log"]).collect()}
    assert got == {"a": "A", "b": "B", "c": None, "d": "D"}
    ev = spark.createDataFrame([(1, 0, None), (1, 1, "t"), (1, 2, None), (1, 3, "1 passed"), (1, 4, "2 failed"), (1, 5, "t")], "log int, idx int, text string")
    res = ledger.attach_results(ev, ["log"], "idx", F.coalesce(F.col("text") == "t", F.lit(False)), F.when(F.col("text").rlike("passed|failed"), F.col("text"))).collect()
    assert {r["test_at"]: r["result"] for r in res} == {1: "1 passed", 5: None}
    top = spark.createDataFrame([(1, i, x) for i, x in enumerate("zayzbx")], "log int, idx int, item string")
    got = ledger.first_seen_top(top, ["log"], "item", "idx", F.col("item") == "b", 3).orderBy("place").collect()
    assert [r["item"] for r in got] == ["b", "z", "a"]


def test_joins(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in joins.last_wins(t, "k", "o").collect()} == {("a", None), ("b", "y")}
    assert {(r["k"], r["v"]) for r in joins.first_wins(t, "k", "o").collect()} == {("a", "x"), ("b", "y")}
    wall = spark.createDataFrame([("a",), ("a",)], "k string")
    assert [r["k"] for r in joins.beyond_wall(t, wall, "k").collect()] == ["b"] and joins.wall_hits(t, wall, "k").count() == 2
    entries = spark.createDataFrame([("n", "2", 0, "two"), ("n", "x", 0, "one"), ("n", "2", 2, "late"), ("n", None, 3, "four")], "log string, card string, place int, e string")
    cards = spark.createDataFrame([("n", i) for i in range(1, 5)], "log string, card int")
    got = {r["card"]: r["e"] for r in joins.by_number_or_place(cards, entries, ["log"], "card", "place").collect()}
    assert got == {1: "one", 2: "two", 3: None, 4: "four"}
    merged = joins.merged_tables([t.select("k", "v"), spark.createDataFrame([("b", "new")], "k string, v string")], "k")
    assert {r["k"]: r["v"] for r in merged.filter("k = 'b'").collect()} == {"b": "new"}
    assert joins.tagged_union({"p": t, "q": wall}).filter("channel = 'q' and v is null").count() == 2
    assert joins.fits_broadcast(t, 3) and not joins.fits_broadcast(t, 2)
    assert joins.with_default(wall, t.filter("k = 'b'"), "k", {"v": "none"}).first()["v"] == "none"


CANDS = [("n", 1, "good", "correct", 1), ("n", 2, "bad", "wrong", 3), ("n", 3, "Good ", "wrong", 2), ("n", 4, "half", "partial", 1), ("n", 5, "odd", None, 4), ("m", 1, "x", "wrong", 1)]


def test_candidate_pairs(spark):
    c = spark.createDataFrame(CANDS, "node_id string, cand_idx int, text string, label string, rank int")
    got = lambda df: sorted((r["text_a"], r["text_b"]) for r in df.collect())
    assert got(pairs.sibling_pairs(c)) == [("good", "bad")]
    real = c.filter("cand_idx in (1, 4) and node_id = 'n'")
    assert got(pairs.worse_than_anchor(c, real)) == [("good", "Good "), ("good", "bad"), ("good", "half"), ("good", "odd"), ("half", "Good "), ("half", "bad"), ("half", "odd")]
    judged = spark.createDataFrame([("n", [[2], [3, 4]], ["above", "below"])], "node_id string, groups array<array<int>>, tiers array<string>")
    keep = pairs.not_worse(judged, c)
    assert [r["text"] for r in keep.collect()] == ["bad"]
    assert ("good", "bad") not in got(pairs.worse_than_anchor(c, real, not_worse=keep))
    assert [(r["chosen"], r["rejected"]) for r in pairs.above_the_real(judged, c, c.filter("cand_idx = 1")).collect()] == [("bad", "good")]
    want = []
    step = {"correct": 2, "partial": 1, "wrong": 0}
    for a, b in itertools.permutations([x for x in CANDS if x[0] == "n"], 2):
        veto = a[3] is not None and b[3] is not None and step[b[3]] > step[a[3]]
        if b[4] > a[4] and not veto:
            want.append((a[2], b[2]))
    assert got(pairs.rank_gap_pairs(c)) == sorted(want)


def test_judge_validators(spark):
    rows = [([[1, 3], [2]], 3, [2, 1], ["above", "par"]), ([[1, 1], [2]], 3, [1, 1], ["above", "odd"]), ([[1], [2]], 3, [1], ["par"]), (None, 3, None, None), ([], 0, [], [])]
    df = spark.createDataFrame(rows, "g array<array<int>>, k int, r array<int>, t array<string>")
    g, k, r, t = map(F.col, "gkrt")
    got = df.select(pairs.valid_partition(g, k).alias("a"), F.coalesce(pairs.valid_ranking(r, g), F.lit(False)).alias("b"), pairs.valid_tiers(t, g).alias("c")).collect()
    assert [tuple(x) for x in got] == [(True, True, True), (False, False, False), (False, False, False), (False, False, False), (True, True, True)]
    one = spark.range(1).select(pairs.unshuffled(F.array(F.array(F.lit(2), F.lit(1)), F.array(F.lit(3))), F.array(F.lit(30), F.lit(10), F.lit(20))).alias("x"), pairs.real_last_dropped(F.array(F.lit(1), F.lit(2)), F.lit(True)).alias("y")).first()
    assert one["x"] == [[10, 30], [20]] and one["y"] == [1]


def test_drop_chain_counts_the_first_reason(spark):
    rows = [(1, "a", "x", 9), (2, None, "x", 1), (3, None, "x", 1), (4, None, "y", 9), (5, None, "y", 1), (6, "a", "z", 1), (7, None, "z", 1), (8, None, None, 1), (9, None, None, 1)]
    df = spark.createDataFrame(rows, "id int, early string, key string, n int").repartition(3)
    got = prep.drop_chain(df, "id", [("early", F.col("early") == "a")], prep.content_print("key"), [("long", F.col("n") > 5)])
    assert {r["id"]: r["reason"] for r in got.collect()} == {1: "early", 2: None, 3: "dup", 4: "long", 5: "dup", 6: "early", 7: None, 8: None, 9: "dup"}
    assert {r["reason"]: r["n"] for r in prep.accounting(got).collect()} == {"early": 2, "dup": 3, "long": 1, "kept": 3, "read": 9}
    assert prep.gate(300, 300)[0] and not prep.gate(299, 300)[0]


def test_caps_and_order_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", i % 7 == 0) for i in range(200)], "id int, k string, v boolean")
    got = [sorted(r["id"] for r in prep.capped(df.repartition(n), "k", 12, "s", "id", [F.col("v").desc()]).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 36
    for k in range(3):
        assert sum(i % 7 == 0 for i in got[0] if i % 3 == k) == min(12, sum(1 for i in range(200) if i % 3 == k and i % 7 == 0))
    order = [[r["id"] for r in prep.shuffled(df.repartition(n), "s", "id").collect()] for n in (1, 5)]
    assert order[0] == order[1] != sorted(order[0])
    assert abs(sum(r["share"] for r in prep.shares(df, "k").collect()) - 1) < 1e-5


def loop_fit(parts, budget):
    total = "\n\n".join(parts)
    if len(total) <= budget:
        return [(i, "all") for i in range(len(parts))]
    n = min(2, len(parts))
    used = min(len("\n\n".join(parts[:n])), 8000, budget)
    tail = []
    for i in reversed(range(n, len(parts))):
        if used + len(parts[i]) > budget:
            break
        tail.append((i, "tail"))
        used += len(parts[i])
    if not tail and len(parts) > n:
        tail = [(len(parts) - 1, "cut")]
    return sorted([(i, "head") for i in range(n)] + tail)


def test_budget_equals_a_loop(spark):
    rng = random.Random(3)
    logs = {k: ["x" * rng.choice([0, 1, 10, 60, 700]) for _ in range(rng.randint(1, 8))] for k in range(80)}
    df = spark.createDataFrame([(k, i, t) for k, ts in logs.items() for i, t in enumerate(ts)], "k int, idx int, text string")
    for budget in (100, 640):
        got = defaultdict(list)
        for r in turns.head_and_recent(df, ["k"], budget).collect():
            got[r["k"]].append((r["idx"], r["place"]))
            if r["place"] == "cut":
                head = min(len("\n\n".join(logs[r["k"]][:2])), 8000, budget)
                assert r["text"] == logs[r["k"]][-1][-max(500, budget - head) :]
        assert {k: sorted(v) for k, v in got.items()} == {k: loop_fit(ts, budget) for k, ts in logs.items()}


def test_turns(spark):
    rows = [(1, 0, "gpt", "hi"), (1, 1, "human", "a"), (1, 2, "human", " "), (1, 3, "human", "b"), (1, 4, "gpt", "c"), (1, 5, "human", "d"), (2, 0, "human", "x")]
    merged = turns.merge_speakers(spark.createDataFrame(rows, "k int, idx int, who string, text string"), ["k"])
    got = sorted((r["k"], r["turn"], r["who"], r["text"]) for r in merged.collect())
    assert got == [(1, 1, "gpt", "hi"), (1, 2, "human", "a\n\nb"), (1, 3, "gpt", "c"), (1, 4, "human", "d"), (2, 1, "human", "x")]
    assert sorted(r["turn"] for r in turns.trim_ends(merged, ["k"]).collect()) == [2, 3]
    log = spark.createDataFrame([(k, i, "assistant" if i % 2 else "user", f"t{i} Some  Claim {i}") for k in (1, 2, 3) for i in range(6)], "k int, idx int, role string, text string")
    bounds = spark.createDataFrame([(1, 4, "zzz"), (2, 99, "some claim 3"), (3, None, "nowhere")], "k int, raw_ref int, hyp string")
    got = defaultdict(list)
    for r in turns.up_to(log, ["k"], bounds).collect():
        got[r["k"]].append(r["idx"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 1, 2, 3], 2: [0, 1, 2]}


def test_fit():
    talk = [("human", "i" * 900), ("gpt", "r" * 50), ("human", "o" * 4001), ("gpt", "r")]
    got = turns.fit(talk, 2500)
    assert got[0] == talk[0] and got[1] == talk[1] and sum(len(t) for _, t in got) <= 2500 and "[truncated]" in got[2][1]
    assert turns.fit(talk, 10_000) == talk and turns.fit(talk, 900) is None
    # ends of the whole text, and the largest is cut first
    talk = [("human", "first"), ("human", "".join(chr(97 + i % 26) for i in range(5000))), ("human", "y" * 1500), ("gpt", "z" * 100)]
    got = turns.fit(talk, 4500)
    assert got[2:] == talk[2:] and got[1][1].startswith(talk[1][1][:1000]) and got[1][1].endswith(talk[1][1][-1000:])
    # what a cut wouldn't shorten stays
    assert turns.fit([("human", ""), ("human", "x" * 310)], 305) is None


def test_streaks_and_counters(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice("frev")) for k in range(40) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame(rows, "k int, idx int, what string").repartition(3)
    run, same, last, want_run, want_same = defaultdict(int), defaultdict(int), {}, {}, {}
    for k, i, w in rows:
        run[k] = run[k] + 1 if w == "f" else 0
        same[k] = same[k] + 1 if last.get(k) == w else 0
        last[k] = w
        want_run[k, i], want_same[k, i] = run[k], same[k]
    assert {(r["k"], r["idx"]): r["streak"] for r in streaks.streaks(df, ["k"], "idx", F.col("what") == "f").collect()} == want_run
    assert {(r["k"], r["idx"]): r["unchanged"] for r in streaks.unchanged(df, ["k"], "idx", "what").collect()} == want_same
    want = []
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        n = None
        for _, _, w in group:
            if w == "f":
                n = 0
            elif w == "e" and n is not None:
                want.append((k, n))
                n = None
            elif w == "r" and n is not None:
                n += 1
    kind = F.col("what")
    got = streaks.between(df, ["k"], "idx", kind == "f", kind == "e", kind == "r").collect()
    assert sorted((r["k"], r["n"]) for r in got) == sorted(want)


def test_intervals(spark):
    rng = random.Random(5)
    rows = [(k, s := rng.randint(1, 200), s + rng.randint(0, 9)) for k in range(20) for _ in range(rng.randint(1, 12))]
    want = []
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        out = []
        for s, e in sorted((max(1, s - 5), e + 5) for _, s, e in group):
            if out and s <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want += [(k, *x) for x in out]
    df = spark.createDataFrame(rows, 'k int, start int, end int').repartition(3)
    assert sorted((r["k"], r["start"], r["end"]) for r in intervals.merged(df, ["k"], widen=5).collect()) == want
    patch = "@@ -1 +1 @@\n+++ b/a.py\n@@ -5 +5 @@\n-x\n+y\n@@ -9,0 +9,2 @@\n+++ b/tests/test_a.py \n@@ -7,3 +7,3 @@"
    df = spark.createDataFrame([(1, patch), (2, None), (3, "")], "id int, patch string")
    got = [(r["file"], r["start"], r["end"]) for r in intervals.hunks(df, ["id"], "patch").orderBy("at").collect()]
    assert got == [("a.py", 5, 6), ("a.py", 9, 10), ("tests/test_a.py", 7, 10)]
    assert df.select(intervals.complexity(F.col("patch"), F.lit(9)).alias("c")).first()["c"] == 15 + 2 + 12


def test_metrics(spark):
    rng = random.Random(6)
    rows = [(f"n{k}", i + 1, float(rng.choice([1, 2, 3])), rng.random() < 0.4) for k in range(30) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "node_id string, cand_idx int, score double, right boolean").repartition(3)
    by = defaultdict(list)
    for n, i, s, y in rows:
        by[n].append((i, s, y))
    for r in metrics.best_of_n(df, 5).collect():
        accs = []
        for c in by.values():
            if len(c) >= r["n"]:
                draws = [max(d, key=lambda x: (x[1], -x[0]))[2] for d in itertools.combinations(c, r["n"])]
                accs.append(sum(draws) / comb(len(c), r["n"]))
        assert r["nodes"] == len(accs) and r["accuracy"] == pytest.approx(sum(accs) / len(accs), abs=1e-6)
    for r in metrics.node_summary(df).collect():
        c = by[r["node_id"]]
        assert (r["k"], r["first_right"], r["picked_right"]) == (len(c), int(c[0][2]), int(max(c, key=lambda x: (x[1], -x[0]))[2]))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0), (None, 1.0)], "x double, y double")
    assert flat.agg(metrics.pearson("x", "y").alias("r")).first()["r"] == 0.0 == flat.limit(2).agg(metrics.pearson("y", "y").alias("r")).first()["r"]
    assert flat.agg(metrics.pearson("y", "y").alias("r")).first()["r"] == 1.0
    got = metrics.bootstrap(df.select("node_id", F.col("right").cast("int").alias("v")), "v", draws=500).first()
    mean = sum(y for *_, y in rows) / len(rows)
    assert got["low"] < mean < got["high"] and got["n"] == len(rows) and got["high"] - got["low"] < 0.35
    q = metrics.quantile_at(df, ["right"], "score", 0.9, "q").collect()
    for r in q:
        xs = sorted(s for *_, s, y in rows if y == r["right"])
        assert r["q"] == xs[int(0.9 * len(xs))]
    s = {(r["dim"], r["value"]): r["n"] for r in metrics.slices(df.withColumn("score", F.col("score").cast("int")), ["score", "node_id"], F.col("right")).collect()}
    assert sum(n for (d, _), n in s.items() if d == "score") == len(rows)
    m = {(r["score"], r["right"]): r["n"] for r in metrics.marginals(df.select("score", "right"), "score", "right").collect()}
    assert m["all", "true"] == sum(y for *_, y in rows)
    arms = metrics.two_arms(spark.createDataFrame([(1, "a", "b")], "i int, out_a string, out_b string"), ["i"], {"out_a": "base", "out_b": "tuned"})
    assert {(r["arm"], r["value"]) for r in arms.collect()} == {("base", "a"), ("tuned", "b")}


def test_hooks(spark):
    pauses, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return x.upper()

    assert hooks.retrying(flaky, sleep=pauses.append)("a") == "A" and pauses == [2.0, 4.0]
    assert hooks.retrying(lambda x: 1 / 0, tries=2, sleep=pauses.append)("a") is None
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    assert {r["id"]: r["answer"] for r in hooks.answered(df, "p", lambda x: x * 2).collect()} == {1: "aa", 2: "bb"}
    logs = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.4), (4, None)], "step int, loss double")
    assert hooks.best_checkpoint(logs, "loss", "step").first()["step"] == 2
    assert hooks.best_checkpoint(logs.filter("loss is null"), "loss", "step").first()["step"] == 4
