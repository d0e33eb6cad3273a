"""Text functions on small tables of cases."""

import base64
import json
import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from trajecta.functions import fixed
from trajecta.functions import text as T
from trajecta.functions.hashing import hash_order, one_in, pick_variant, sha_mod, split_bucket
from trajecta.functions.pandas_udfs import case_passes, close_values, context_windows, decode_cases, outputs_agree, similarity, decoded_cases


def values(spark, f, rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    df = df.withColumn("__i", F.monotonically_increasing_id())
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns[:-1]]).alias("y"), "__i").orderBy("__i").collect()]


COMMANDS = [
    ("pytest tests/test_a.py -q", "swe", "test"),
    ("cd /app && python -m pytest -x", "swe", "test"),
    ("FOO=1 BAR=2 cd src && sed -i s/a/b/ x.py", "swe", "edit"),
    ("grep -rn 'make build' .", "tb", "read"),
    ("make -j4", "tb", "edit"),
    ("make -j4", "swe", "read"),
    ("ls && npm install", "tb", "edit"),
    ("echo x > conf.yaml", "tb", "edit"),
    ("echo x > conf.yaml", "swe", "read"),
    ("python3 solution.py < in", "lcb", "test"),
    ("python3 solution.py < in", "swe", "read"),
    ("cat > a.py <<E", "swe", "edit"),
    ("echo COMPLETE_TASK_AND_SUBMIT", "swe", "submit"),
    ("cat a.py", "swe", "read"),
    ("sed -i s/a/b/ t.py && pytest", "swe", "edit"),
    (None, "swe", "read"),
]


def test_commands(spark):
    got = values(spark, lambda c, k: T.classify_command(c, k), [c[:2] for c in COMMANDS], "c string, k string")
    assert got == [c[2] for c in COMMANDS]
    assert values(spark, T.substrate, ["tb__x", "lcb__1", "a__b-1", None]) == ["tb", "lcb", "swe", "swe"]
    assert values(spark, T.content_slot, ["cat a/b.py", "cat a.py b.py", "grep x a.py", "cat > a.py", "sed -n 1,9p a.py"]) == ["a/b.py", None, None, None, "a.py"]


def test_feedback_and_errors(spark):
    said = ["a guidance round: tests FAILED. Reconsider your current HYPOTHESIS", "tests FAILED. Reconsider your current HYPOTHESIS", "tests FAILED", "fine", None]
    assert values(spark, T.trigger, said) == ["oracle", "self_rescue", None, None, None]
    assert values(spark, lambda x: T.mask_feedback(x, "M"), said) == ["M", "M", "M", "fine", None]
    assert values(spark, T.is_injected, ["All tests pass. Task solved.", "ok", None]) == [True, False, False]
    errors = ["This model's MAXIMUM CONTEXT length is 8", "prompt is too long", "Too many tokens in it", "timeout", "502", None, "rate limit"]
    assert values(spark, T.is_context_overflow, errors) == [True, True, True, False, False, False, False]


def test_lines_and_keys(spark):
    assert values(spark, T.normalise_line, ["  a \n\t b ", None, "  c"]) == ["a b", "", "c"]
    assert values(spark, T.fold_key, ["A  b"]) == ["a b"]
    long = "x" * 260
    rows = [("A b", "a  B"), (long, long + " more"), ("short", "short one"), ("", ""), (None, None)]
    assert values(spark, T.same_or_cut, rows, "a string, b string") == [True, True, False, False, False]
    assert values(spark, lambda a, b: T.first_truthy(a, b), [("", "y"), (None, "y"), ("x", "y"), ("", "")], "a string, b string") == ["y", "y", "x", ""]
    assert values(spark, lambda x: T.middle_cut(x, 4, "~"), ["abcd", "abcdef", None]) == ["abcd", "ab~ef", None]
    assert values(spark, lambda x: T.elide_lines(x, 4, 1000), ["abcd\nabcdefgh"]) == ["abcd\nab...<4 chars>...gh"]
    assert values(spark, T.judged_output, ["  a  \nb \n", None]) == ["a\nb", ""]
    assert values(spark, T.problem_id, ["a/b c"]) == ["lcb__a_b_c"]
    assert values(spark, T.image_name, ["instance_Org__P-1-vnan"]) == ["org__p-1"]
    assert values(spark, lambda x: T.token_estimate(x), ["a" * 7, None]) == [2.0, 0.0]


def test_anchors_and_grounding(spark):
    text = "`x y` and src/a.py, load_cache, ab_c, CacheStore, fail_to_pass, line 12 of conf.toml"
    assert set(values(spark, T.anchors, [text])[0]) == {"x y", "src/a.py", "load_cache", "CacheStore"}
    assert set(values(spark, lambda x: T.anchors(x, wide=True), [text])[0]) == {"x y", "src/a.py", "load_cache", "CacheStore", "conf.toml", "line:12"}
    rows = [("no code", "any"), ("load_cache in src/a.py", "src/a.py only"), ("load_cache CacheStore other_name", "load_cache"), (None, "x"), ("load_cache", None)]
    assert values(spark, T.is_grounded, rows, "a string, b string") == [True, True, False, True, False]
    gate = lambda c, a, b: T.probe_gate(c, T.anchors(a), b)
    assert values(spark, gate, [(True, "load_cache", "x"), (True, "load_cache", "load_cache"), (True, "none", "x"), (False, "load_cache", "x")], "c boolean, a string, b string") == [True, False, False, False]


def test_hidden_tokens_and_redaction(spark):
    names = [(["a/test_file.py::test_case_one", "TestLoad", "reads the whole file again."],), (None,)]
    assert values(spark, T.test_tokens, names, "x array<string>") == [["reads the whole file again.", "test_case_one", "TestLoad"], []]
    assert "test_file" in values(spark, lambda x: T.test_tokens(x, last_segment=False), names, "x array<string>")[0]
    rows = [("run test_a and test_a_b, not pretest_a. $1", ["test_a", "test_a_b"]), ("x", []), ("a.b*c", ["b*c"]), (None, ["a"])]
    schema = "x string, t array<string>"
    assert values(spark, lambda x, t: T.redact(x, t, "#$"), rows, schema) == ["run #$ and #$, not pretest_a. $1", "x", "a.#$", None]
    assert values(spark, lambda x, t: T.redactions(x, t), rows, schema)[:3] == [2, 0, 1]
    assert values(spark, lambda x, t: T.leaked_tokens(x, t), rows, schema)[:3] == [["test_a", "test_a_b"], [], ["b*c"]]
    assert values(spark, lambda s, t: T.secret_tokens(s, t, ["install"]), [("install libfoo-dev /etc/foo.conf", "about libfoo-dev")], "s string, t string")[0][0] == "/etc/foo.conf"
    assert values(spark, lambda o, t: T.hidden_values(o, t), [([" 123 ", "7", "42x"], "see 42x")], "o array<string>, t string") == [["123"]]


def test_rewrites(spark):
    said = ["The oracle guidance helps. Oracle database stays, the oracle ruled out X; reviewers stay", "a reviewer's note. Reviewer", None]
    assert values(spark, T.rewrite_phrases, said) == ["The failure diagnosis helps. Oracle database stays, the earlier attempt's failure ruled out X; reviewers stay", "a failure diagnosis. Diagnosis", None]
    assert values(spark, T.neutral_words, ["Redirected by the Oracle; redirection, redirects"]) == ["turned by the analysis; turn, redirects"]
    assert values(spark, T.soften_redirect, ["should have redirected attention to an HTTP redirect; redirects focus, redirecting away"]) == ["should have turned attention to an HTTP redirect; turns focus, turning away"]


def test_labels(spark):
    answer = "FLAW: a CHECK: b\nNEXT CHECK: c\nVERDICT: good\n"
    assert values(spark, T.labels_in_order, [answer, None, "x VERDICT: y"]) == [["FLAW", "NEXT CHECK", "VERDICT"], [], []]
    assert values(spark, lambda x: T.rename_labels(x, fixed.SKINS["review"]), [answer]) == ["Weakness: a CHECK: b\nFollow-up: c\nJudgment: good"]
    note = lambda x: T.schema_note(T.labels_in_order(x), {"FLAW": "Gap"})
    assert values(spark, note, [answer, ""]) == ["\n\nUse exactly these section labels, in this order: Gap / NEXT CHECK / VERDICT.", ""]
    assert values(spark, lambda x: T.section(x, "FLAW: ", r"\nNEXT CHECK:"), [answer, "none"]) == ["a CHECK: b", ""]
    assert values(spark, lambda x: T.before(x, "\nNEXT"), [answer]) == ["FLAW: a CHECK: b"]
    assert values(spark, T.one_line_hypothesis, ["x\nhypothesis:  a   b\nc", "plain  text", None]) == ["a b", "plain text", ""]
    assert values(spark, T.last_hypothesis, ["HYPOTHESIS: a\nHYPOTHESIS: b ", "none"]) == ["b", ""]


def test_observations(spark):
    seen = "<output>\nsrc/a.py:12: hit\nno\n b.c:3:x \n</output> src/z.py:1: out"
    assert values(spark, T.search_hits, [seen, "a.py:1: y", None]) == [["src/a.py:12: hit", "b.c:3:x"], ["a.py:1: y"], []]
    assert values(spark, T.file_names, ["see a/b.py, c.md and d"]) == [["a/b.py", "c.md"]]
    parts = lambda x: F.struct(*[c.alias(n) for n, c in zip(("a", "b"), T.split_lines_by(x, " -- "))])
    got = values(spark, parts, ["a -- b\n\nc\nd -- e"])[0]
    assert (got["a"], got["b"]) == (["a -- b", "d -- e"], ["c"])
    data = [(b"a\r\nb",), (b"a\r\nb\x00",), (b"",)]
    assert [bytes(x) for x in values(spark, T.crlf_to_lf, data, "x binary")] == [b"a\nb", b"a\r\nb\x00", b""]


def test_content_and_json(spark):
    content = ['"plain"', '[{"text": "a"}, {"content": "b"}, "c", {"x": 1}]', '{"text": "t"}', "not json", None, "null"]
    assert values(spark, T.flat_content, content) == ["plain", "a\nb\nc\n", "t", "not json", "", "null"]
    got = values(spark, lambda x: T.json_object(x, "a int")["a"], ['```json\n{"a": 1}\n```', 'so: {"a": 2} ok', "none", None, '{"a": 3}'])
    assert got == [1, 2, None, None, 3]
    told = ['["a", "b"]', "['a', \"b's\"]", "('a', None,)", "['a\\x41', 'b' 'c']", None, " "]
    assert values(spark, T.literal_list, told) == [["a", "b"], ["a", "b's"], ["a", None], ["aA", "bc"], [], []]
    assert values(spark, lambda x: T.literal_list(x, strict=False), ["nope", "f()"]) == [[], []]
    with pytest.raises(Exception, match="neither JSON nor a Python list"):
        values(spark, T.literal_list, ["nope"])


def test_arrays(spark):
    xs = [([1, 2, 3, 4, 5],), ([1],), ([],)]
    assert values(spark, lambda x: T.last_n(x, 2), xs, "x array<int>") == [[4, 5], [1], []]
    assert values(spark, lambda x: T.head_and_tail(x, 3), xs, "x array<int>") == [[1, 4, 5], [1], []]
    assert values(spark, lambda x: T.ladder(x, fixed.LABEL_LADDER), ["correct", "odd", None]) == [2, 0, 0]
    assert values(spark, lambda x: T.map_with_prefix(x, {"r1": "A"}, {"pro": "P"}, "D"), ["r1", "pro9", "z"]) == ["A", "P", "D"]
    assert values(spark, lambda x: T.bullets(x), [(["a", "b"],)], "x array<string>") == ["- a\n- b"]


def test_hashes(spark):
    import hashlib

    ids = [f"id-{i}" for i in range(50)] + ["", "ü"]
    big = [int(hashlib.sha1(x.encode()).hexdigest(), 16) for x in ids]
    for m in (4, 100, 10_000, 20_000):
        assert values(spark, lambda x, m=m: sha_mod(x, m), ids) == [b % m for b in big]
    assert values(spark, lambda x: one_in(x, 4), ids) == [b % 4 == 0 for b in big]
    want = [None if b % 10_000 >= 1500 else ["p", "q"][b // 10_000 % 2] for b in big]
    assert values(spark, lambda x: pick_variant(x, 0.15, ["p", "q"]), ids) == want
    assert set(values(spark, lambda x: split_bucket(x, [("a", 70), ("b", 100)]), ids)) == {"a", "b"}
    assert values(spark, lambda x: hash_order("s", x), ["a"]) == [hashlib.sha1(b"s|a").hexdigest()]


def test_python_functions(spark):
    import difflib

    assert values(spark, similarity, [("abcd", "bcde"), (None, "")], "a string, b string") == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0]
    assert values(spark, lambda x: context_windows(x, "hit", 2, 4), ["a hit b\nhit", None]) == [["a hit b h", "b hit"], []]
    assert outputs_agree("1 \n2", "1\n2") and outputs_agree("2.0", "2.00000") and outputs_agree("[1, [2]]", "[1.0000001, [2]]")
    assert not outputs_agree("1", "2") and not outputs_agree("true", "1") and not close_values([1], [1, 2])
    assert values(spark, case_passes, [("a ", "a"), (None, ""), ("1", "2")], "a string, b string") == [True, True, False]
    cases = [{"input": "1", "output": "2", "testtype": "stdin"}]
    coded = base64.b64encode(zlib.compress(pickle.dumps(json.dumps(cases)))).decode()
    assert decode_cases(json.dumps(cases)) == decode_cases(coded) == cases
    assert decode_cases("!") == decode_cases(None) == decode_cases(base64.b64encode(b"x").decode()) == []

    class Evil:
        def __reduce__(self):
            return (print, ("ran",))

    assert decode_cases(base64.b64encode(zlib.compress(pickle.dumps(Evil()))).decode()) == []
    assert values(spark, decoded_cases, [coded])[0][0]["output"] == "2"


@pytest.mark.parametrize("labels", [fixed.LABELS])
def test_fixed_values_fit(labels):
    assert all(list(s) == list(labels) for s in (*fixed.SKINS.values(), fixed.TRANSFER_SKIN))


def test_render(spark):
    from trajecta.functions import render

    one = lambda sql, f: spark.sql(sql).select(f.alias("x")).first()["x"]
    card = "select array(named_struct('cmd', 'pytest', 'result', '1 passed'), named_struct('cmd', 'ls', 'result', '')) as t, array('e') as e, array('h') as h, array('a.py', 'b.py') as i"
    assert one(card, render.evidence(*map(F.col, "tehi"))) == "- ran test `pytest` -> 1 passed\n- ran test `ls`\n- edited: e\n- found: h\n- inspected: a.py, b.py"
    none = "select cast(array() as array<struct<cmd:string,result:string>>) as t, cast(array() as array<string>) as e"
    assert one(none, render.evidence(F.col("t"), F.col("e"), F.col("e"), F.col("e"))) == "(exploration / reading only)"
    talk = "select array(named_struct('role', 'user', 'content', 'abcdef'), named_struct('role', 'gpt', 'content', cast(null as string))) as m"
    assert one(talk, render.transcript(F.col("m"), 3)) == "[user] abc\n[gpt] "
    assert one(talk, render.hit_places(F.col("m"), ["cd"])) == [0]
    assert one("select array('x', 'y') as a", render.digest(F.col("a"), "H", "-")) == "H1: x\nH2: y" and one(none, render.digest(F.col("e"), "H", "-")) == "-"
    assert one("select array('a', 'b', 'c', 'd') as f", render.feedback(F.col("f"), F.lit(2))) == "FAILED a\nFAILED b\nFAILED c\nhidden failures: 2"
    assert one("select '' as a, 'b' as b", render.prompt([("A:", F.col("a")), ("B:", F.col("b"))], "Q?")) == "B:\nb\n\nQ?"
    assert one("select array('b', 'a') as x", render.fingerprint(F.col("x"))) == one("select array('a', 'b') as x", render.fingerprint(F.col("x")))
    small = "select array('xx', 'y', 'z') as i, array(true, true, true) as f, array(2, 1, 1) as n"
    assert one(small, render.smallest(*map(F.col, "ifn"))) == "y"
