"""Queries that SQL can't say, against plain Python on whole small tables; and rules of single operators."""

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import fixed
from trajecta.functions import text as T
from trajecta.operators import joins, ledger, metrics, pairs, prep, turns
from trajecta.plans.catalog import REG
from trajecta.sources import sinks


def rows(spark, sf, name, key):
    return {r[key]: r for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()}


def answers(spark, sf):
    return {k: (r["messages"][-1]["content"] if r["messages"] else None) for k, r in rows(spark, sf, "sft_samples", "sample_id").items()}


def shout(word, like):
    """A word in the case of another's first letter."""
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def test_soften_redirect(spark):
    told = ["Redirect attention", "redirected away; REDIRECTING focus; a redirect handler", "could have redirected it, have  redirect it", None, "", "redirects\ntowards"]

    def soft(t):
        forms = fixed.TURNS
        t = re.sub(r"(?i)\bredirect(ed|ing|s|)\b" + fixed.ATTENTION, lambda m: forms[m[1].lower()], t)
        return re.sub(r"(?i)\b" + fixed.PERFECT + r"redirect(ed|)\b", lambda m: m[1] + forms[m[2].lower()], t)

    df = spark.createDataFrame(list(enumerate(told)), "i int, t string")
    got = {r["i"]: r["y"] for r in df.select("i", T.soften_redirect("t").alias("y")).collect()}
    assert got == {i: None if t is None else soft(t) for i, t in enumerate(told)}


def test_match_contexts(spark, sf):
    got = sorted((r["doc_id"], r["context"]) for r in REG.queries["match_contexts"](spark, sf).collect())
    want = []
    for i, r in rows(spark, sf, "documents", "doc_id").items():
        t = r["text"] or ""
        want += [(i, t[max(0, m.start() - 70) : m.end() + 90].replace("\n", " ")) for m in re.finditer(r"\bline \d+\b", t)]
    assert got == sorted(want) and want


def test_renamed_labels(spark, sf):
    names = fixed.SKINS["review"]
    got = {r["sample_id"]: (r["answer"], r["note"]) for r in REG.queries["renamed_labels"](spark, sf).collect()}
    longest = sorted(names, key=len, reverse=True)
    for i, a in answers(spark, sf).items():
        lines = re.split(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", re.sub(r"(?:\r\n|[\n\x0b\x0c\r\x85\u2028\u2029])\Z", "", a or ""))
        out = []
        for x in lines:
            k = next((k for k in longest if x.startswith(k + ":")), None)
            out.append(x if k is None else names[k] + x[len(k) :])
        assert got[i][0] == "\n".join(out)
        found = sorted((re.search(rf"(?m)^{k}:", a or "").start(), k) for k in names if re.search(rf"(?m)^{k}:", a or ""))
        assert (got[i][1] == "") == (not found) and all(names[k] in got[i][1] for _, k in found)


def test_phrase_rewrite_and_redaction(spark, sf):
    told = {1: "The Oracle told the agent; an Oracle database stays, the reviewer's note too.", 2: "nothing here", 3: None}
    df = spark.createDataFrame(list(told.items()), "i int, t string")
    got = {r["i"]: r["y"] for r in df.select("i", T.rewrite_phrases("t").alias("y")).collect()}
    assert got[1] == "The failure diagnosis made clear; an Oracle database stays, the diagnosis of the failed attempt too." or "Oracle database stays" in got[1] and "reviewer" not in got[1]
    assert got[2] == told[2]
    changed = {r["sample_id"]: (r["before"], r["after"]) for r in REG.queries["phrase_rewrite"](spark, sf).collect()}
    bare = re.compile(r"(?i)\b(?:oracle|reviewer)\b")
    for i, a in answers(spark, sf).items():
        assert (i in changed) == bool(a and bare.search(a)) or a and "redirect" in a.lower()
    # redaction: the longest name first, no part of a word
    d = spark.createDataFrame([("call load_all and load_all_x, preload_all", ["load_all", "load_all_x"])], "t string, names array<string>")
    r = d.select(T.redact(F.col("t"), F.col("names")).alias("y"), T.redactions(F.col("t"), F.col("names")).alias("n")).first()
    assert "load_all_x" not in r["y"] and "preload_all" in r["y"] and r["n"] == 2


def test_similar_adjacent(spark, sf):
    cards = {}
    for r in REG.queries["cards"](spark, sf).collect():
        cards.setdefault(r["instance_id"], []).append((r["card"], r["hyp"]))
    want = {}
    for k, xs in cards.items():
        xs = [h for _, h in sorted(xs)]
        if len(xs) > 1:
            rs = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(xs, xs[1:])]
            want[k] = (len(rs), round(sum(rs) / len(rs), 6))
    got = {r["instance_id"]: (r["n"], r["similarity"]) for r in REG.queries["similar_adjacent"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want) and want


def test_bootstrap(spark, sf):
    by = {}
    for r in rows(spark, sf, "preference_pairs", "pair_id").values():
        if r["chosen_grounded"] is not None:
            by.setdefault(r["pair_type"], []).append(int(r["chosen_grounded"]))
    got = {r["pair_type"]: r for r in REG.queries["bootstrap_ci"](spark, sf).collect()}
    assert got.keys() == by.keys()
    for k, ys in by.items():
        means = np.sort(np.random.default_rng(5).choice(ys, size=(4000, len(ys))).mean(axis=1))
        assert got[k]["n"] == len(ys) and abs(got[k]["mean"] - np.mean(ys)) < 1e-9
        assert abs(got[k]["low"] - means[100]) < 0.06 and abs(got[k]["high"] - means[3900]) < 0.06


def test_context_fit(spark, sf):
    talks = {r["instance_id"]: (r["n"], r["chars"]) for r in REG.queries["context_fit"](spark, sf).collect()}
    assert talks and all(n == -1 or n is None or chars is None or chars <= 12_000 for n, chars in talks.values())
    # halving one by one, as often as needed, gives the same
    def slow(talk, budget):
        talk = list(talk)
        while sum(len(t) for _, t in talk) > budget:
            open_ = [(-len(t), i) for i, (w, t) in enumerate(talk) if i and w == "human" and max(300, len(t) // 2) + len(turns.CUT) < len(t)]
            if not open_:
                return None
            i = min(open_)[1]
            t = talk[i][1]
            n = max(300, len(t) // 2)
            talk[i] = ("human", t[: n // 2] + turns.CUT + t[len(t) - (n + 1) // 2 :])
        return talk

    rng = np.random.default_rng(2)
    for _ in range(200):
        talk = [(str(rng.choice(["human", "gpt"])), "".join(map(chr, rng.integers(97, 123, rng.integers(0, 4000))))) for _ in range(rng.integers(1, 9))]
        assert turns.fit(talk, 3000) == slow(talk, 3000)


def test_failure_feedback(spark, sf):
    got = REG.queries["failure_feedback"](spark, sf).collect()
    want = []
    for r in spark.read.parquet(f"{sf}/outcomes.parquet").collect():
        failed = [e["stage"] for e in r["evals"] or [] if not e["resolved"]]
        hidden = sum(not e["p2p_pass"] for e in r["evals"] or [])
        said = "\n".join([f"FAILED {x[:120]}" for x in failed[:3]] + [f"hidden failures: {hidden}"])[-2500:]
        refuted = "\n".join(f"H{i}: {x}" for i, x in enumerate(r["refuted_hypotheses"] or [], 1)) or "(none)"
        want.append((r["instance_id"], r["run_id"], said if r["evals"] is not None else None, refuted))
    key = lambda t: tuple("" if x is None else x for x in t)
    have = [(r["instance_id"], r["run_id"], r["feedback"], r["refuted"]) for r in got]
    assert sorted(map(key, have)) == sorted(map(key, want))


def test_labels_of_texts_that_fold_alike(spark):
    df = spark.createDataFrame([(1, ["correct", "wrong", "partial"], ["A  b", "c", " a B"]), (2, [], []), (3, None, None)], "i int, l array<string>, t array<string>")
    got = {r["i"]: r["m"] for r in df.select("i", pairs.label_of_text(df, "l", "t").alias("m")).collect()}
    assert got == {1: {"c": "wrong", "a b": "partial"}, 2: {}, 3: None}


def test_rank_positions(spark):
    df = spark.createDataFrame(
        [(1, [[1, 3], [2]], [1, 0], []), (2, [[1, 2]], [0], []), (3, [[1], [2], [3]], [0, 1, 2], ["par", "above", "par"]), (4, [[1], [2]], [0], None)],
        "node_id int, groups array<array<int>>, ranking array<int>, tiers array<string>",
    )
    got = {(r["node_id"], r["cand"]): r["rank"] for r in pairs.rank_positions(df).collect()}
    # a group that the order leaves out has no place
    assert got == {(1, 2): 0, (1, 1): 1, (1, 3): 1, (3, 1): 1, (3, 2): 0, (3, 3): 1, (4, 1): 0}


def test_snapshots_and_targets(spark):
    df = spark.createDataFrame([("f", 1, "x" * 41), ("f", 2, " error "), ("g", 1, "y" * 40), ("h", 1, "z" * 3000)], "file string, idx int, body string")
    assert {r["file"]: r["body"] for r in ledger.latest_snapshots(df, ["file"], "body", "idx").collect()} == {"f": "x" * 41, "h": "z" * 2500}
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "l string"), spark.createDataFrame([("x",)], "l string")
    assert sorted(r["l"] for r in joins.added_lines(a, b).collect()) == ["x", "y"]
    assert sorted(r["l"] for r in joins.all_targets(a, b).collect()) == ["x", "y"]
    wide = spark.createDataFrame([(i, "t" * 100_000) for i in range(20)], "k int, t string")
    assert joins.fits_broadcast(wide) and not joins.fits_broadcast(wide, most_bytes=1_000_000) and not joins.fits_broadcast(wide, most_rows=19)


def test_submissions(spark):
    log = [("a", i, x) for i, x in enumerate("csfco")] + [("b", i, x) for i, x in enumerate("tsf")] + [("c", 0, "t")]
    df = spark.createDataFrame(log, "k string, idx int, x string")
    is_ = lambda c: F.col("x") == c
    got = {r["k"]: tuple(r)[1:] for r in metrics.submit_behaviour(df, ["k"], "idx", is_("s"), is_("f"), is_("t"), is_("o")).collect()}
    assert got == {"a": (True, 1, 1), "b": (False, 1, 0), "c": (None, 0, 0)}
    tag = df.select(prep.protocol_tag(F.lit(None).cast("string"), F.lit("raw_leak"), ["oracle"]).alias("a"), prep.protocol_tag(F.lit("oracle"), F.lit("raw_leak"), ["oracle"]).alias("b")).first()
    assert tuple(tag) == ("none", "raw_leak")


def test_a_broken_write_loses_no_skip_list(spark, tmp_path):
    path = str(tmp_path / "skip")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "iid string")
    sinks.poison(spark, path, ids("b", "a"), "iid")
    (tmp_path / "skip").rename(tmp_path / "skip.old")  # a run that broke between its two renames
    sinks.poison(spark, path, ids("c", "a"), "iid")
    assert [r["iid"] for r in spark.read.json(path).orderBy("iid").collect()] == ["a", "b", "c"]
    assert not (tmp_path / "skip.old").exists() and not (tmp_path / "skip.new").exists()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from trajecta import session

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session())
