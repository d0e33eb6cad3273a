"""Problem 2: prompt and response pairs whose answer is no usable answer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.splits import contract
from trajecta.session import cut, spread

# The labels that sections of answers go by, by the part that they name.
PARTS = {
    "audit": (("verdict", "judgment", "assessment"), ("support", "evidence basis", "grounding"), ("flaw", "weakness", "gap"), ("next check", "follow-up", "next action")),
    "propose": (("hypothesis", "claim"), ("reasoning", "why", "rationale"), ("check", "test", "verification")),
    "probe": (("gap in the previous attempt", "previous gap", "prior gap"), ("still missing", "unknown", "missing evidence"), ("where to probe next", "where to look", "probe next")),
}
# What stands in place of an answer.
PLACEHOLDERS = frozenset("none null nil nan na n/a tbd todo tba wip pending empty placeholder undefined unknown answer response here your insert text xxx diff patch blank".split())
# Frequent function words of languages in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in that is for with before after which when not this has are was by an its only from into if does runs",
    "de": "der die das und ist nicht wird mit von ein eine den auf nur wenn vor dann als fehlt dem zum bitte wir jedes",
    "fr": "le la les est et des une dans que pour avec sur jamais il du au faut dès seulement nous été cette à",
    "es": "el los las y en una con por se del nunca falta hay que luego aunque cuanto primero fue después la",
    "pt": "os as em uma com por não do da nunca é dos falta assim que depois pela foi quando primeiro deve mas o",
    "it": "il gli di che è e non una per con della nel sono dopo prima solo quando viene lo",
    "nl": "de het een en van is niet dat voor met op aan wordt alleen als naar bij",
}
# How answers decline; what says so needs to recur under one prompt fewer.
DECLINING = re.compile(
    r"\b(?:unable to|can(?:no|')?t|cannot|won't|will not|not able to|not comfortable|rather not|must decline|have to decline|decline to|goes? beyond what i|not permit(?:ted)?|not allowed"
    r"|no assessment will|do(?:n't| not) have access|against my|my guidelines|as an ai|not something i|refuse|refrain|cannot be (?:fulfilled|provided|answered)|not going to)\b"
)
_LABEL = {name: (kind, i) for kind, parts in PARTS.items() for i, names in enumerate(parts) for name in names}
_HEAD = re.compile(r"(?im)^[^\S\n]*(?:[>*#_\"'“”`-]+[^\S\n]*)?(" + "|".join(sorted((re.escape(x).replace(r"\ ", r"\s+") for x in _LABEL), key=len, reverse=True)) + r")[*_]*\s*[::]")
_CODE = re.compile(r"`[^`\n]*`|\S*(?:[_/\\()=<>{}\[\]]|\w\.\w)\S*|\b[^\W\d_]*[a-z][A-Z]\w*|\d+")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_END = re.compile(r"[.!?。!?][\"'”’»)`*\]]*$")
_CLOSED = re.compile(r"(?:`[^`\s][^`]*`|\blines \d+ to \d+|\(both in [^()]+\)|\bsee \S+:\d+|\bsearch \S+ for \S+|\bnone(?: needed)?|\blimit=\d+|== -?\d+)[\"'”’*]*$", re.I)
_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_SENTENCE = re.compile(r"^.*?[.!?。!?](?=\s|$)", re.S)
ANSWERS, ASKS = frozenset(("assistant", "gpt", "model", "bot")), frozenset(("user", "human"))
#: Words in a shingle, hash functions, rows in a band, and the similarity from which openings belong together.
SHINGLE, HASHES, ROWS, SIMILAR = 5, 60, 5, 0.8
_SEEDS = np.random.default_rng(7).integers(1, 2**61 - 1, size=(2, HASHES), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def language(text: str) -> str | None:
    """The language that most of a text is in, its labels and code aside; None where too little tells."""
    plain = _CODE.sub(" ", _HEAD.sub(" ", text))
    kana, han, hangul, cyrillic = (len(re.findall(f"[{x}]", plain)) for x in ("぀-ヿ", "㐀-鿿", "가-힯", "Ѐ-ӿ"))
    words = re.findall(r"[^\W\d_]+", plain.lower())
    latin = sum(len(w) for w in words) - kana - han - hangul - cyrillic
    # a character of a syllabary or a logograph says about as much as two letters
    sizes = {"cjk": 2 * (kana + han), "ko": 2 * hangul, "ru": cyrillic, "latin": latin}
    script = max(sizes, key=lambda k: sizes[k])
    if sizes[script] < 8:
        return None
    if script == "cjk":
        return "ja" if kana * 8 > han else "zh"
    if script != "latin":
        return script
    said = {k: sum(w in v for w in words) for k, v in _WORDS.items()}
    first, second = sorted(said, key=lambda k: -said[k])[:2]
    return first if said[first] >= 3 and said[first] > 1.3 * said[second] else None


def copied(answer: str, asked: str, share: float = 0.9, lead: int = 8) -> bool:
    """Whether runs of the question's words make up the answer, a lead-in of at most `lead` words aside.

    Runs have five words, or 24 characters of a script without spaces, where shorter ones are stock phrases.
    """
    a = _TOKEN.findall(_HEAD.sub(" ", answer).lower())
    run = 24 if not answer.isascii() and sum(len(x) == 1 and x > "\u3000" for x in a) * 2 > len(a) else SHINGLE
    if len(a) < run:
        return False
    # an answer of which no word but a lead-in is new is rare: the words decide before their runs do
    q = _TOKEN.findall(_HEAD.sub(" ", asked).lower())
    words = set(q)
    if sum(x in words for x in a) < share * (len(a) - lead):
        return False
    number = {w: i for i, w in enumerate(words, 1)}
    hit_at = np.isin(_runs([number.get(x, 0) for x in a], run), _runs([number[x] for x in q], run))
    if not hit_at.any():
        return False
    edge = np.zeros(len(a) + 1, dtype=np.int64)
    starts = np.nonzero(hit_at)[0]
    edge[starts] += 1
    np.subtract.at(edge, starts + run, 1)
    hit = np.cumsum(edge)[:-1] > 0
    start = int(starts[0])
    return start <= lead and bool(hit[start:].mean() >= share)


def _runs(ids: list[int], width: int) -> np.ndarray:
    """64-bit values of all runs of `width` numbers."""
    x, n = np.array(ids, dtype=np.uint64), len(ids) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    return out


def patch_ends_early(patch: str) -> bool:
    """Whether a unified diff lacks a hunk, or lines that its last hunk's header promises, or the rest of its last line."""
    lines = [x for x in re.sub(r"(?m)^```\w*[^\S\n]*$", "", patch).split("\n") if x.strip()]
    open_file, old, new = False, None, None
    for x in lines:
        m = _HUNK.match(x.strip())
        if x.startswith("diff --git"):
            if open_file or (old or 0) > 0 or (new or 0) > 0:
                return True
            open_file, old, new = True, None, None
        elif m:
            if (old or 0) > 0 or (new or 0) > 0:
                return True
            open_file, old, new = False, int(m[1] or 1), int(m[2] or 1)
        elif old is not None:
            old -= not x.startswith("+")
            new -= not x.startswith("-")
    if open_file or old is None or old > 0 or new > 0:
        return True
    last = lines[-1][1:].strip()
    return any(last.count(x) != last.count(y) for x, y in ("()", "[]")) or last.count('"') % 2 == 1 or not re.search(r"\W", last)


def ends_early(answer: str) -> bool:
    """Whether prose stops before its end: no closing mark, and none of the forms that end without one."""
    text = answer.rstrip()
    last = text.split("\n")[-1]
    head = None
    for head in _HEAD.finditer(text):
        pass
    if head is not None and not re.search(r"\w", text[head.end() :]):
        return True
    return "…" in text[-2:] or last.endswith("...") or not (_END.search(last) or (_CLOSED.search(last) and last.count("`") % 2 == 0))


def is_empty(answer: str | None) -> bool:
    """Null, blanks, marks, bare labels and placeholders only."""
    words = re.findall(r"n/a|[^\W_]+", _HEAD.sub(" ", answer or "").lower())
    return all(w in PLACEHOLDERS for w in words)


def opening(answer: str) -> str:
    """The first sentence behind a label, code masked, quotes made plain.

    Where no sentence ends it is the whole answer, or nothing if that has several labels: then it is one that breaks off.
    """
    plain, labels = _HEAD.subn("", answer)
    plain = plain.strip().replace("’", "'")
    m = _SENTENCE.match(plain)
    return re.sub(r"\s+", " ", _CODE.sub("#", m[0] if m else plain if labels < 2 else "")).lower()


def cores(said: str, lead: int = 8) -> list[int]:
    """Hashes of what is left of an opening behind a lead-in of 0 to `lead` words, five words at least; of a shorter one, itself."""
    w = re.findall(r"[^\W_]+|#", said)
    rests = [" ".join(w[i:]) for i in range(max(1, min(lead + 1, len(w) - SHINGLE + 1)))]
    return pd.util.hash_array(np.array(rests, dtype=object)).astype(np.int64).tolist()


def shingles(text: str) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle."""
    w = re.findall(r"[^\W_]+|#", text)
    runs = [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]
    return np.unique(pd.util.hash_array(np.array(runs, dtype=object)))


def bands(hashes: np.ndarray) -> list[int]:
    """MinHash signature folded into bands."""
    x = hashes[:, None] * _SEEDS[0] + _SEEDS[1]
    x ^= x >> np.uint64(29)
    low = (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0).reshape(-1, ROWS)
    return pd.util.hash_array(np.array([f"{i}|" + "|".join(map(str, r)) for i, r in enumerate(low)], dtype=object)).astype(np.int64).tolist()


def look(answer: str | None, asked: str | None) -> tuple[str | None, str | None, int, str, int]:
    """(defect or None, family, parts as bits, opening, text) of an answer by itself; text is a hash of its words."""
    if is_empty(answer):
        return "empty", None, 0, "", 0
    asked = asked or ""
    named = [_LABEL[re.sub(r"\s+", " ", x.lower())] for x in _HEAD.findall(answer)]
    family = named[0][0] if named else None
    parts = {p for k, p in named if k == family}
    if len(parts) < 2 and copied(answer, asked):
        return "copied", None, 0, "", 0
    ours = language(answer)
    if ours and (theirs := language(asked)) and theirs != ours:
        return "other_language", None, 0, "", 0
    text = int.from_bytes(blake2b(" ".join(re.findall(r"[^\W_]+", answer.lower())).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
    if re.search(r"(?m)^(?:diff --git|@@ -|--- a/)", answer):
        return ("truncated" if patch_ends_early(answer) else None), "patch", 0, "", text
    return (None if not ends_early(answer) else "truncated"), family, sum(1 << p for p in parts), opening(answer), text


def needed(sizes: Mapping[tuple[str | None, str, int], int], always: float) -> tuple[dict[tuple[str | None, str], int], dict[str, int]]:
    """The parts (as bits) that `always` of the distinct answers have, of each type and family, and of each family in any type.

    sizes: distinct answers by type, family and parts. A family that is rare in a type (at most 1 - always of its
    answers, such as refusals under a wrong label) says nothing about the type; there what the family needs anywhere holds.
    """
    types, own, anywhere = Counter(), {}, {}
    for (kind, family, parts), n in sizes.items():
        types[kind] += n
        if family in PARTS:
            own.setdefault((kind, family), Counter())[parts] += n
            anywhere.setdefault(family, Counter())[parts] += n

    def need(found: Counter) -> int:
        bits = range(max(map(len, PARTS.values())))
        return sum(1 << i for i in bits if sum(n for parts, n in found.items() if parts >> i & 1) >= always * found.total())

    return {k: need(x) for k, x in own.items() if x.total() > (1 - always) * types[k[0]]}, {f: need(x) for f, x in anywhere.items()}


def broken_answers(samples: DataFrame, row_id: str, kind: str, messages: str, recurring: int = 3, always: float = 0.95, seldom: float = 0.1) -> DataFrame:
    """(row_id, `defect`): samples whose last answer is defective, with one of
    `empty`, `copied`, `other_language`, `refusal` and `truncated`, the first that fits in this order.

    Empty, copied and other-language answers, unfinished patches and unfinished prose show in a sample by itself.
    Refusals show in the corpus: the openings (first sentences, of any length) of answers without the parts of an
    answer are clustered by MinHash over runs of five words, candidates of a band verified at a Jaccard similarity of
    0.8, and by what is left behind a short lead-in. A cluster is a refusal template if it recurs under at least
    `recurring` unrelated prompts (one fewer where it declines in words), without a word of code, and if complete
    answers open like that in at most a share of `seldom`. Words alone make no refusal: what nobody says twice stays
    what it shows by itself. Which parts an answer needs also comes from the corpus: each that `always` of the distinct
    answers of its type and family have, copies and answers that are defective by themselves aside.

    Only distinct openings meet, in equi-joins; hot templates are one row there, and a lead-in's rest links all that
    share it to one of them. Null messages, no messages and a last turn by the user are empty answers. Repeated samples
    each come out. An empty table gives no rows.
    """
    k = dict(samples.dtypes)[row_id]
    turns = F.filter(F.coalesce(F.col(messages), F.array().cast(dict(samples.dtypes)[messages])), lambda m: m.isNotNull())
    slim = samples.select(F.col(row_id).alias("__id"), F.col(kind).cast("string").alias("__kind"), turns.alias("__m"))
    role = lambda m: F.lower(F.regexp_replace(F.coalesce(m["role"], F.lit("")), r"(?U)^\s+|\s+$", ""))
    last = F.try_element_at("__m", F.lit(-1))
    asked = F.transform(F.filter(F.slice("__m", 1, F.greatest(F.size("__m") - 1, F.lit(0))), lambda m: role(m).isin(*ASKS)), lambda m: m["content"])
    slim = slim.select("__id", "__kind", F.when(role(last).isin(*ANSWERS), last["content"]).alias("__answer"), F.coalesce(F.try_element_at(asked, F.lit(-1)), F.lit("")).alias("__q"))
    slim = slim.withColumn("__asked", F.xxhash64("__q"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [look(a, q) for a, q in zip(b["__answer"], b["__q"])]
            yield pd.DataFrame({"__id": b["__id"], "__kind": b["__kind"], "__asked": b["__asked"]} | {n: [g[i] for g in got] for i, n in enumerate(("defect", "family", "parts", "said", "text"))})

    seen = cut(spread(slim).mapInPandas(scan, f"__id {k}, __kind string, __asked bigint, defect string, family string, parts int, said string, text bigint"))
    whole = seen.filter("defect is null and family is not null").groupBy("__kind", "family", "parts").agg(F.countDistinct("text").alias("n"))
    own, anywhere = needed({(r["__kind"], r["family"], r["parts"]): r["n"] for r in whole.collect()}, always)  # types x families x parts
    enough: Column = F.lit(0)
    for family, bits in anywhere.items():
        enough = F.when(F.col("family") == family, bits).otherwise(enough)
    for (of, family), bits in own.items():
        enough = F.when(F.col("__kind").eqNullSafe(of) & (F.col("family") == family), bits).otherwise(enough)
    # a patch needs no parts, an answer without any label never has enough
    lacking = F.when(F.col("family") == "patch", False).otherwise(F.col("family").isNull() | (F.col("parts").bitwiseAND(enough) != enough))
    seen = seen.withColumn("lacking", lacking)
    refusals = refusing(seen.filter("said <> '' and (defect is null or defect = 'truncated')").select("said", "__asked", "lacking"), recurring, seldom)
    out = seen.join(refusals.withColumn("refusal", F.lit(True)), "said", "left")
    defect = (
        F.when(F.col("defect").isin("empty", "copied", "other_language"), F.col("defect"))
        .when(F.col("lacking") & F.col("refusal"), "refusal")
        .when((F.col("defect") == "truncated") | F.col("lacking"), "truncated")
    )
    return out.select(F.col("__id").alias(row_id), defect.alias("defect")).filter(F.col("defect").isNotNull())


def refusing(openings: DataFrame, recurring: int, seldom: float) -> DataFrame:
    """(`said`): the openings of refusal templates, of rows (`said`, `__asked`, `lacking`)."""
    # prompts are counted with an opening, and once more over a cluster; complete answers by rows
    counted = openings.groupBy("said").agg(F.count_if(~F.col("lacking")).alias("complete"), F.count_if("lacking").alias("lacking"))
    distinct = cut(counted.filter("lacking > 0"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(x) for x in b["said"]]
            declines = [DECLINING.search(x) is not None for x in b["said"]]
            yield pd.DataFrame({"said": b["said"], "grams": [x.astype(np.int64) for x in sets], "bands": [bands(x) for x in sets], "cores": [cores(x) for x in b["said"]], "declines": declines})

    signed = cut(distinct.select("said").mapInPandas(sign, "said string, grams array<bigint>, bands array<bigint>, cores array<bigint>, declines boolean"))
    keyed = signed.select("said", F.explode("bands").alias("band"))
    pairs = keyed.alias("x").join(keyed.alias("y"), "band").filter("x.said > y.said").select(F.col("x.said").alias("a"), F.col("y.said").alias("b")).distinct()
    grams = signed.select("said", "grams")
    pairs = pairs.join(grams.select(F.col("said").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("said").alias("b"), F.col("grams").alias("gb")), "b")
    alike = F.size(F.array_intersect("ga", "gb")) >= SIMILAR * F.size(F.array_union("ga", "gb"))
    rests = signed.select("said", F.explode("cores").alias("core"))
    firsts = rests.groupBy("core").agg(F.min("said").alias("b"))
    same = rests.join(firsts, "core").filter("said > b").select(F.col("said").alias("a"), "b")
    roots = contract(pairs.filter(alike).select("a", "b").union(same))
    named = distinct.join(roots.select(F.col("node").alias("said"), "root"), "said", "left").withColumn("root", F.coalesce("root", "said"))
    named = cut(named.join(signed.select("said", "declines"), "said"))
    # an opening with code speaks of its own prompt, so that its recurring says nothing
    plain = named.filter(~F.contains("said", F.lit("#"))).select("said", "root")
    heard = openings.filter("lacking").join(plain, "said").groupBy("root").agg(F.countDistinct("__asked").alias("prompts"))
    tally = named.groupBy("root").agg(F.sum("complete").alias("complete"), F.sum("lacking").alias("lacking"), F.max("declines").alias("declines")).join(heard, "root")
    bad = tally.filter((F.col("prompts") >= recurring - F.col("declines").cast("int")) & (F.col("complete") <= seldom * (F.col("complete") + F.col("lacking"))))
    return named.join(bad.select("root"), "root", "left_semi").select("said")
