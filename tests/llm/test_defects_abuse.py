"""Defective answers and abusive language: cases with known results, and held-out accuracy."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from trajecta.llm.abuse import OTHER_SCRIPTS, Channel, Lexicon, fit, lattice, letter_counts, rarities, score_documents, viterbi, word_counts
from trajecta.llm.defects import broken_answers, copied, ends_early, is_empty, language, patch_ends_early

GOOD = "HYPOTHESIS: the cache in a/b_{i}.py keeps entry {i} across calls.\nREASONING: The report names entry {i} twice and nothing else.\nCHECK: run `pytest tests/test_{i}.py`"
ASK = "ISSUE:\nThe cache in a/b_{i}.py returns entry {i} although it was removed before the call of load_{i}().\n\nName the most likely cause of the defect that is described here."
MESSAGES = "array<struct<role:string,content:string>>"


def sample(i, answer, kind="propose", ask=None, roles=("user", "assistant")):
    return (i, kind, [{"role": roles[0], "content": ASK.format(i=i) if ask is None else ask}] + ([] if len(roles) < 2 else [{"role": roles[1], "content": answer}]))


def test_defects(spark):
    rows = [sample(i, GOOD.format(i=i)) for i in range(90)]
    want = {}

    def add(defect, answer, **kw):
        i = 100 + len(rows)
        rows.append(sample(i, answer(i) if callable(answer) else answer, **kw))
        if defect:
            want[i] = defect

    for x in ("", None, " \n", "...", "HYPOTHESIS:\nREASONING:\nCHECK: -", "```\n```", "N/A", "​"):
        add("empty", x)
    add("empty", None, roles=("user",))
    # templates recur under unrelated prompts, whatever leads in, whatever their length, with no listed phrase or with one
    for x in ("I'm sorry, but I can't help with that.", "I can't help with that.", "HYPOTHESIS: Unfortunately I am unable to assist with this request.", "I am unable to assist with this request."):
        add("refusal", x)
    for x in ("No assessment will be provided. Ask somebody else about a/b_1.py.", "Regretfully, no assessment will be provided."):
        add("refusal", x)
    for x in ("I cannot help.", "Not today, friend.", "Questions of this sort are better kept among friends of the house.", "That falls outside my remit today"):
        for _ in range(4):
            add("refusal", x)
    for x in ("them", "everybody"):
        for _ in range(2):
            add("refusal", f"Matters like these are for the people of the house who long ago gathered all that there is to know and who keep it from {x}.")
    # what nobody says twice, or what complete answers open with as well, is no template
    add("truncated", "My lips are sealed on everything that is asked here.")
    for i in range(3):
        add("truncated", "HYPOTHESIS: Some entry is kept.")
    for i in range(9):
        rows.append(sample(700 + i, f"HYPOTHESIS: Some entry is kept.\nREASONING: The report names entry {i} twice.\nCHECK: run `pytest tests/test_{i}.py`"))
    add("copied", lambda i: "You asked: " + ASK.format(i=i))
    add("copied", lambda i: "HYPOTHESIS: " + ASK.format(i=i).split("\n")[1].upper())
    add("other_language", "HYPOTHESIS: Der Fehler tritt nur auf, wenn der Eintrag vor dem Aufruf angelegt wird und nicht danach.\nREASONING: In der Zeile fehlt die Prüfung auf den letzten Eintrag, und das ist falsch.")
    add("other_language", "HYPOTHESIS: Похоже, что последний элемент никогда не сбрасывается.\nREASONING: Ошибка возникает, только если элемент создаётся раньше.")
    german = "Der Fehler tritt nur auf, wenn der Eintrag vor dem Aufruf angelegt wird. Bitte die Ursache nennen, die am ehesten dafür in Frage kommt und nicht nur eine."
    add(None, "HYPOTHESIS: Vermutlich wird die Prüfung nicht vor dem Aufruf gemacht und das ist der Grund.\nREASONING: In der Zeile fehlt sie, und nur dann tritt es auf.\nCHECK: run `pytest tests/test_1.py`", ask=german)
    add("truncated", lambda i: GOOD.format(i=i)[:90])
    add("truncated", lambda i: GOOD.format(i=i).split("\nREASONING")[0])
    add("truncated", lambda i: GOOD.format(i=i).rsplit(" run", 1)[0])
    add(None, "GAP IN THE PREVIOUS ATTEMPT: It rests on a name.\nSTILL MISSING: I am not able to tell from this who writes it.\nWHERE TO PROBE NEXT: Look at the callers of load_1().", kind="probe")
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a = 1\n-b = f(2)\n+b = f(3)"
    add(None, diff, kind="fix")
    add("truncated", diff[:-10], kind="fix")
    add("truncated", diff.rsplit("\n", 1)[0], kind="fix")
    add("truncated", diff.split("@@")[0], kind="fix")
    rows += [(900, None, None), (901, "audit", [])]
    want |= {900: "empty", 901: "empty"}
    df = spark.createDataFrame(rows, f"id long, type string, messages {MESSAGES}").withColumn("defect", F.lit("clash")).withColumn("said", F.lit(1))
    got = {r["id"]: r["defect"] for r in broken_answers(df, "id", "type", "messages").collect()}
    assert got == want
    twice = broken_answers(df.union(df), "id", "type", "messages")
    assert twice.count() == 2 * len(want)
    assert broken_answers(df.limit(0), "id", "type", "messages").count() == 0


AUDIT = "VERDICT: entry {i} is likely.\nSUPPORT: The report names entry {i} twice.\nFLAW: It rests on one name of {i}.\nNEXT CHECK: read a/b_{i}.py, lines 1 to 2"


def test_parts_are_learned_from_distinct_answers_of_a_type(spark):
    rows = [sample(i, AUDIT.format(i=i), kind="audit") for i in range(40)]
    # one answer without its last part, copied in other forms until it is a third of all
    short = AUDIT.format(i=77).split("\nNEXT")[0]
    rows += [sample(100 + i, short.upper() if i % 2 else short.replace(":", " :"), kind="audit") for i in range(20)]
    rows.append(sample(200, AUDIT.format(i=5).split("\nNEXT")[0], kind="audit"))
    # one type may leave out a part that another always has
    rows += [sample(300 + i, GOOD.format(i=i) if i % 2 else GOOD.format(i=i).split("\nCHECK")[0], kind="short") for i in range(40)]
    rows += [sample(400 + i, GOOD.format(i=i), kind="long") for i in range(40)] + [sample(500, GOOD.format(i=3).split("\nCHECK")[0], kind="long")]
    # parts count by name: as many as others have, but not the same ones
    rows.append(sample(501, "REASONING: The report names it.\nCHECK: run `pytest tests/test_1.py`", kind="short"))
    df = spark.createDataFrame(rows, f"id long, type string, messages {MESSAGES}")
    got = {r["id"]: r["defect"] for r in broken_answers(df, "id", "type", "messages").collect()}
    assert got == dict.fromkeys([*range(100, 120), 200, 500, 501], "truncated")


def test_defect_parts():
    assert is_empty("VERDICT:\nFLAW: -") and not is_empty("VERDICT: good\nFLAW: none.")
    assert language("`code_only()` a/b.py 12") is None and language("Die Prüfung fehlt in der Zeile und das ist nicht gut") == "de"
    assert language("最後の要素が初期化されていないようです。") == "ja" and language("只有在重启之后才会出错，尽管已被删除。") == "zh"
    assert not copied("HYPOTHESIS: an own thought about this thing here", "another text altogether that shares no run of words")
    assert ends_early("It is so beca") and not ends_early("CHECK: read a/b.py, lines 1 to 2") and ends_early("Fine.\nCHECK:")
    assert patch_ends_early("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a()\n+b(")


@pytest.fixture(scope="module")
def taught(spark, sf):
    """Channel, labels as restored sentences with verdicts, and word counts, of the small tables."""
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), word_counts(spark.read.parquet(f"{sf}/documents.parquet"), "text")
    channel = Channel(letter_counts(counts))
    rows = spark.read.parquet(f"{sf}/review_labels.parquet").filter("category is not null and text is not null").orderBy("text").collect()
    snippets = [(list(channel.sentences(r["text"])), r["category"] != "none") for r in rows]
    return channel, snippets, {r["w"]: r["n"] for r in counts.collect()}, docs.count()


def fitted(taught, snippets=None):
    snippets = taught[1] if snippets is None else snippets
    return fit(snippets, Lexicon(), rarities(snippets, *taught[2:]))


def test_channel_restores(taught):
    ch = taught[0]
    for told, meant in (
        ("you 1d10t", "you idiot"),
        ("a c l o w n, always", "a clown always"),
        ("d.i.m.w.i.t and", "dimwit and"),
        ("idiiiiot", "idiot"),
        ("j*****s", "jackass"),
        ("mоrоn", "moron"),
        ("CLO​WN", "clown"),
        ("W0R7HL355", "worthless"),
        ("you b@$tard", "you bastard"),
        ("ｃｌｏｗｎ", "clown"),
        ("mоrоn imbécil", "moron imbecil"),
        ("XXX", "xxx"),
        ("a brain-dead, non-code read-only x", "a braindead non code read only x"),
        ("you are a l_o_s_e_r", "you are a loser"),
    ):
        assert ch.restore(told) == meant
    for harmless in ("read line 1178 of v2", "0 6 5 and 7", "at 12 30 code", "a b"):
        assert ch.restore(harmless) == harmless
    assert viterbi(lattice("cl0wn"), ch.lm)[0] == "clown"
    assert list(ch.sentences("One two. Three!\n\nfour f.x g (five?) six")) == [["one", "two"], ["three"], ["four", "f", "x", "g", "five"], ["six"]]
    assert list(ch.sentences(" \n ")) == []


def test_long_tokens_are_restored(taught):
    for n in (5, 30, 5000):
        assert taught[0].restore("you " + "".join(c * n for c in "idiot")) == "you idiot"


def test_code_hides_no_abuse(taught):
    ch, judge = taught[0], fitted(taught)
    for told in ("you are a l_o_s_e_r!", "you are an _idiot_ again", "_you idiot_", "you stupid moron/idiot", "<b>you idiot</b>", "you idiot.Go away", "you 1d10t/m0r0n", "YouIdiot", "you <i class='x'>idiot</i>"):
        assert judge.score(ch.sentences(told)) >= 0.5, told
    for code in ("src/a_b/main.py", "x=f(y)", "List<String>", "java.util.Map", "HashMap", "load_1()", "a/b/c/d", "`you idiot`"):
        assert ch.restore(code) == "#", code


def test_words_of_other_scripts_are_found(taught):
    ch, judge = taught[0], fitted(taught)
    for word in OTHER_SCRIPTS:
        for form in ("NFC", "NFD"):
            assert judge.score(ch.sentences(unicodedata.normalize(form, f"{word}. The cache is full."))) >= 0.5, word
    for told in ("Ты cука", "СУКА", "ﾊﾞｶ", "バカヤロー"):
        assert judge.score(ch.sentences(told)) >= 0.5, told
    for fine in ("Шкура барсука.", "バカンスです。", "전원이 꺼졌다.", "йод и ёж"):
        assert judge.score(ch.sentences(fine)) < 0.5, fine


ABUSE = ["You are a w0rthless idiot and everyone knows it.", "Kys, nobody would miss you.", "Send me your nudes.", "Never trust a Zorblan, they lie and steal.", "Touch this again and I will break your fingers.", "Eres un imbécil.", "Du bist ein I D I O T.", "You people should not exist.", "I will find you and stab you.", "Eres una mierda de persona."]
FINE = ["Kill the zombie child process.", "I was an idiot for trusting this; my own mistake.", "This stupid cache is garbage.", "The block list for porn sites is loaded here.", "A moderator removed 3 hateful comments.", "Strip the naked pointer.", "Thank you for your help, you are great.", "Your patch breaks my tests, could you look at it?", "", None, "  "]


def test_scores(spark, sf):
    rows = [(i, t) for i, t in enumerate(ABUSE + FINE)] + [(0, ABUSE[0]), (99, "fine line. " * 20_000 + ABUSE[1])]
    docs = spark.createDataFrame(rows, "id long, t string").withColumn("score", F.lit("clash")).withColumn("z", F.lit("s")).withColumn("w", F.lit(1))
    labels = spark.read.parquet(f"{sf}/review_labels.parquet").select("text", "category").union(spark.createDataFrame([("?", None), (None, "hate")], "text string, category string"))
    got = score_documents(docs, "id", "t", labels, "text", "category", ["w"]).collect()
    bad = {r["id"] for r in got if r["score"] >= 0.5}
    assert bad == {*range(len(ABUSE)), 99} and len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    # without labels the assumed weights stand
    plain = score_documents(docs, "id", "t", labels.limit(0), "text", "category").collect()
    assert len(plain) == len(rows) and not {r["id"] for r in plain if r["score"] >= 0.5} & {*range(len(ABUSE), len(ABUSE + FINE))}
    assert score_documents(docs.limit(0), "id", "t", labels, "text", "category").count() == 0


def families(snippets):
    """Snippets by likeness of their sentences, so that one wording is never on both sides of a fold."""
    firsts, of = [], []
    bags = [[frozenset(s) for s in said] for said, _ in snippets]
    for i, (_, bad) in enumerate(snippets):
        like = lambda r: snippets[r][1] == bad and any(len(a & b) / len(a | b) >= 0.45 for a in bags[r] for b in bags[i])
        k = next((n for n, r in enumerate(firsts) if like(r)), len(firsts))
        if k == len(firsts):
            firsts.append(i)
        of.append(k)
    return of


def held_out(taught, of, folds=5):
    """(recall, harmless snippets flagged) of snippets whose group was in no training fold."""
    groups = list(range(max(of) + 1))
    random.Random(3).shuffle(groups)
    fold = {g: n % folds for n, g in enumerate(groups)}
    found = missed = wrong = 0
    for n in range(folds):
        judge = fitted(taught, [x for x, g in zip(taught[1], of) if fold[g] != n])
        for (said, bad), g in zip(taught[1], of):
            if fold[g] == n:
                hit = judge.score(said) >= 0.5
                found, missed, wrong = found + (hit and bad), missed + (bad and not hit), wrong + (hit and not bad)
    return found / (found + missed), wrong


def test_held_out_accuracy(taught):
    """Snippets held out at random, then whole wordings held out, which no training snippet shows."""
    recall, wrong = held_out(taught, list(range(len(taught[1]))))
    assert recall >= 0.9 and wrong <= 2
    recall, wrong = held_out(taught, families(taught[1]))
    assert recall >= 0.65 and wrong <= 5


def test_the_lists_alone_find_clearly_less(taught):
    bad = [said for said, y in taught[1] if y]
    share = lambda judge: sum(judge.score(said) >= 0.5 for said in bad) / len(bad)
    assert share(fit([], Lexicon(), {})) < 0.7 and share(fitted(taught)) >= 0.98


def test_the_corpus_teaches_words(spark, sf):
    """A group that no snippet names is learned from the sentences that other words give away."""
    labels = spark.read.parquet(f"{sf}/review_labels.parquet")
    rows = [(i, f"The Zorblan are vermin and row {i} is theirs.") for i in range(6)] + [(6, "Ban the Zorblan from row 7.")] + [(10 + i, f"Row {i} has the index of row {i + 1}.") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, t string")
    for rounds, want in ((0, set(range(6))), (2, set(range(7)))):
        got = score_documents(docs, "id", "t", labels, "text", "category", rounds=rounds).collect()
        assert {r["id"] for r in got if r["score"] >= 0.5} == want


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p5_splits", "p6_found", "p7_ids", "p8_containers", "p9_found", "p1_kept_by_type", "p3_counts", "p4_items", "p6_groups", "p9_rates"])
def test_queries_run(spark, sf, name):
    from trajecta.llm.queries import REG

    assert REG.queries[name](spark, sf).count() > 0
