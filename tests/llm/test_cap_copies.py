"""Caps and copies against plain Python."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trajecta.llm.cap import apportion, stratified_cap
from trajecta.llm.copies import bare, bare_lines, fold_copies
from trajecta.llm.identity import instance_key


def rounds(slots, weights, names):
    """Largest remainder over names; ties by place in names."""
    total = sum(weights[n] for n in names)
    if not total:
        return dict.fromkeys(names, 0)
    exact = {n: Fraction(slots * weights[n], total) for n in names}
    out = {n: int(exact[n]) for n in names}
    left = slots - sum(out.values())
    for n in sorted(names, key=lambda n: (-(exact[n] - out[n]), names.index(n)))[:left]:
        if exact[n] > out[n]:
            out[n] += 1
    return out


def expected_quotas(sizes, cap, weights):
    names = sorted(sizes, key=lambda n: (-sizes[n], n))
    take = {n: min(q, sizes[n]) for n, q in rounds(cap, weights, names).items()}
    room = {n: sizes[n] - take[n] for n in names}
    spare = min(cap - sum(take.values()), sum(room.values()))
    more = rounds(spare, room, names)
    return {n: take[n] + more[n] for n in names}


@pytest.mark.parametrize("weighted", [False, True])
def test_apportion_is_largest_remainder(spark, weighted):
    rng = random.Random(3)
    cells = [(f"k{k}", s, rng.choice([1, 2, 3, 7, 40])) for k in range(60) for s in rng.sample("abcde", rng.randint(1, 5))]
    weight = (lambda s: F.ascii(s) - 96) if weighted else None
    got = apportion(spark.createDataFrame(cells, "__k string, __s string, __n long"), 8, weight).collect()
    by = defaultdict(dict)
    for k, s, n in cells:
        by[k][s] = n
    assert len(got) == len(cells)
    for k, sizes in by.items():
        want = expected_quotas(sizes, 8, {s: ord(s) - 96 if weighted else n for s, n in sizes.items()})
        assert {r["__s"]: r["__quota"] for r in got if r["__k"] == k} == want
        assert sum(want.values()) == min(8, sum(sizes.values()))


def test_cap_keeps_the_best_of_a_hot_contributor(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice(["verified", "other", None]), rng.choice([None, 1, 2, 3])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, who string, tier string, q int").withColumn("kept", F.lit("clash")).withColumn("__k", F.lit(1))
    tier = F.when(F.col("tier") == "verified", "verified").otherwise("other")
    got = {r["id"]: r["kept"] for r in stratified_cap(df, "id", F.col("who"), [(F.col("q"), "desc")], cap=8, stratum=tier, weight=lambda s: (s == "verified").cast("int")).collect()}
    keep = {i for i, who, _, _ in rows if who is None}
    for who in ("hot", "b", "c"):
        own = sorted((r for r in rows if r[1] == who), key=lambda r: (r[2] != "verified", -(r[3] or 0), r[0]))
        keep |= {r[0] for r in own[:8]}
    assert {i for i, k in got.items() if k} == keep and len(got) == len(rows)


def test_cap_edges(spark):
    empty = spark.createDataFrame([], "id long, who string, q int")
    assert stratified_cap(empty, "id", F.col("who"), [(F.col("q"), "desc")], cap=3).count() == 0
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 1), (3, "a", None)], "id long, who string, q int")
    got = stratified_cap(df, "id", F.col("who"), [(F.col("q"), "desc")], cap=1).collect()
    assert [r["kept"] for r in sorted(got, key=lambda r: r["id"])] == [True, True, False, False]
    assert not any(r["kept"] for r in stratified_cap(df, "id", F.col("who"), [(F.col("q"), "desc")], cap=0).collect())
    share = stratified_cap(df, "id", F.col("who"), [(F.col("q"), "desc")], share=0.5).collect()
    assert {r["id"] for r in share if r["kept"]} == {1, 2}
    with pytest.raises(ValueError, match="cap or a share"):
        stratified_cap(df, "id", F.col("who"), [])


def test_instance_key(spark):
    same = ["org__proj-12", " Org/Proj#12\n", "instance_ORG__PROJ-12-vab12cd", "org/proj-012-vnan", "ORG__proj-12\t"]
    other = ["org__proj-13", "org__proj-x-12", "orgs__proj-12", "tb__proj-12", "something else", "  ", None]
    rows = spark.createDataFrame([(x,) for x in same + other], "x string").select("x", instance_key(F.col("x")).alias("k")).collect()
    keys = {r["x"]: r["k"] for r in rows}
    assert {keys[x] for x in same} == {"org|proj|12"}
    assert keys["  "] is None and keys[None] is None and keys["something else"] == "something else"
    assert len({keys[x] for x in other if keys[x]}) == 5 and "org|proj|12" not in {keys[x] for x in other}


TEXT = {"c": bare_lines, "p": bare}


def folded(spark, rows):
    df = spark.createDataFrame(rows, "id long, p string, c string").withColumn("first_id", F.lit(9)).withColumn("__c0", F.lit(9))
    return {r["id"]: (r["first_id"], r["n_copies"]) for r in fold_copies(df, "id", TEXT).collect()}


def test_copies_by_form(spark):
    a = ("Ask: x_1?", "HYPOTHESIS: One two.\nREASONING: three\nCHECK: four")
    rows = [
        (5, *a),
        (3, "ask x1", "hypothesis: ONE  two\r\n\r\ncheck:four\nREASONING - : three!"),
        (4, "ASK X 1", "CHECK: four\nHYPOTHESIS: one two\nREASONING: three"),
        (6, "ask x2", a[1]),
        (7, a[0], "REASONING: three one two"),
        (8, "Straße", None),
        (9, "STRASSE", ""),
        (10, None, None),
        (11, "", "..."),
    ]
    got = folded(spark, rows)
    assert got == {3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (6, 1), 7: (7, 1), 8: (8, 2), 9: (8, 2), 10: (10, 2), 11: (10, 2)}


def test_copies_of_a_hot_group_and_none(spark):
    rng = random.Random(2)
    said = [rng.choice(["Hot one"] * 3 + [f"t {i}" for i in range(5)]) for _ in range(300)]
    rows = [(i, x.upper() if i % 2 else x + "!", "same") for i, x in enumerate(said)]
    got = folded(spark, rows)
    sizes = Counter(said)
    assert {i: n for i, (_, n) in got.items()} == {i: sizes[x] for i, x in enumerate(said)}
    assert {i: f for i, (f, _) in got.items()} == {i: said.index(x) for i, x in enumerate(said)}
    assert folded(spark, rows[:0]) == {}


def test_cap_by_type_against_plain_python(spark, sf):
    """p1_kept_by_type on a table: every row once, quotas by largest remainder, the best of each type."""
    from trajecta.llm.queries import REG, instance_key as key

    pairs = spark.read.parquet(f"{sf}/preference_pairs.parquet")
    rows = pairs.select("pair_id", key(F.col("instance_id")).alias("k"), F.coalesce("pair_type", F.lit("")).alias("s"), "strength", "rank_gap").collect()
    got = {r["pair_id"]: r["kept"] for r in REG.queries["p1_kept_by_type"](spark, sf).collect()}
    keep, by = {r["pair_id"] for r in rows if r["k"] is None}, defaultdict(lambda: defaultdict(list))
    for r in rows:
        if r["k"] is not None:
            by[r["k"]][r["s"]].append(r)
    for strata in by.values():
        sizes = {s: len(x) for s, x in strata.items()}
        for s, n in expected_quotas(sizes, 8, sizes).items():
            best = sorted(strata[s], key=lambda r: ((r["strength"] or "").strip().lower() != "verified", r["rank_gap"] is None, -(r["rank_gap"] or 0), r["pair_id"]))
            keep |= {r["pair_id"] for r in best[:n]}
    assert len(got) == len(rows) and {i for i, k in got.items() if k} == keep and len(keep) < len(rows)
