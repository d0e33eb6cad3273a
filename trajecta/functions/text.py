"""Text operators as column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajecta.functions import fixed
from trajecta.functions.pandas_udfs import python_list

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: C) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def strip(x: C) -> Column:
    """Without white space at both ends (all of it, not only blanks)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalise_line(x: C) -> Column:
    """One line: ends stripped, runs of white space one blank; null gives the empty text."""
    return strip(F.regexp_replace(text_or_empty(x), r"(?U)\s+", " "))


def fold_key(x: C) -> Column:
    """normalise_line, letter case aside."""
    return F.lower(normalise_line(x))


def truthy(x: C) -> Column:
    return text_or_empty(x) != ""


def first_truthy(*xs: C) -> Column:
    """The first text that isn't null or empty; the last one where none is."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in xs], _c(xs[-1]))


def contains_any(x: C, needles: Sequence[str]) -> Column:
    """Whether any of the fixed texts occurs; null gives false."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(text_or_empty(x), F.lit(n))
    return hit


def occurs_in(needle: Column, text: Column) -> Column:
    return F.coalesce(F.contains(text, needle), F.lit(False))


def mask_feedback(x: C, mask: str) -> Column:
    """The mask where the harness speaks, else the text."""
    return F.when(contains_any(x, fixed.FEEDBACK_MARKERS), F.lit(mask)).otherwise(_c(x))


def is_injected(x: C) -> Column:
    return contains_any(x, fixed.INJECTED_MARKERS)


def is_context_overflow(x: C) -> Column:
    return contains_any(F.lower(text_or_empty(x)), fixed.OVERFLOW_MARKERS)


def trigger(x: C) -> Column:
    """Which feedback an observation brings: `oracle`, else `self_rescue`, else null."""
    t = text_or_empty(x)
    told = F.contains(t, F.lit("guidance round")) | F.contains(t, F.lit("WHERE your reasoning is wrong"))
    failed = F.contains(t, F.lit("tests FAILED")) & F.contains(t, F.lit("Reconsider your current HYPOTHESIS"))
    return F.when(told, "oracle").when(failed, "self_rescue")


def substrate(instance_id: C) -> Column:
    i = text_or_empty(instance_id)
    return F.when(i.startswith("tb__"), "tb").when(i.startswith("lcb__"), "lcb").otherwise("swe")


def classify_command(command: C, kind: C | None = None) -> Column:
    """`submit`, `edit`, `test` or `read`, in this order of priority, after variables and a leading cd."""
    c, kind = strip(text_or_empty(command)), F.lit("swe") if kind is None else _c(kind)
    bare = F.regexp_replace(F.regexp_replace(c, r"^(?:[A-Z_]+=\S+\s+)+", ""), r"^cd\s+\S+\s*&&\s*", "")
    edit = bare.rlike(fixed.EDITS) | ((kind == "tb") & bare.rlike(fixed.TERMINAL_EDITS))
    test = bare.rlike(fixed.TESTS) | ((kind == "lcb") & bare.rlike(fixed.SOLUTION_TESTS))
    return F.when(F.contains(c, F.lit(fixed.SUBMIT)), "submit").when(edit, "edit").when(test, "test").otherwise("read")


def content_slot(command: C) -> Column:
    """The one file whose content a command shows; null unless it names exactly one."""
    files = file_names(command)
    return F.when(_c(command).rlike(fixed.CONTENT_READS) & (F.size(files) == 1), F.element_at(files, 1))


def file_names(x: C) -> Column:
    return F.regexp_extract_all(text_or_empty(x), F.lit(fixed.FILE_NAME), F.lit(0))


def output_body(x: C) -> Column:
    """What stands in <output> tags, or all where there are none."""
    tagged = r"(?s)<output>\n?(.*?)\n?</output>"
    return F.when(text_or_empty(x).rlike(tagged), F.regexp_extract(x, tagged, 1)).otherwise(text_or_empty(x))


def search_hits(x: C, width: int = 160) -> Column:
    """The lines `file.ext:line:` of an observation, cut to width."""
    lines = F.transform(F.split(output_body(x), r"\R"), strip)
    return F.transform(F.filter(lines, lambda s: s.rlike(fixed.SEARCH_HIT)), lambda s: F.substring(s, 1, width))


def _all(x: C, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(x), F.lit(pattern), F.lit(group))


def anchors(x: C, wide: bool = False) -> Column:
    """Concrete code in a text: backticked spans, paths, snake_case and CamelCase; wide: more paths, and `line:N`."""
    ticked = F.filter(F.transform(_all(x, fixed.BACKTICKED, 1), strip), lambda s: F.length(s) >= 3)
    paths = _all(x, fixed.CODE_PATH_WIDE if wide else fixed.CODE_PATH)
    snake = F.filter(_all(x, fixed.SNAKE), lambda s: (F.length(s) >= 6) & ~s.isin(*fixed.ANCHOR_STOP))
    camel = F.filter(_all(x, fixed.CAMEL), lambda s: F.length(s) >= 6)
    found = F.array_union(F.array_union(ticked, paths), F.array_union(snake, camel))
    if wide:
        found = F.array_union(found, F.transform(_all(x, r"\bline (\d+)\b", 1), lambda s: F.concat(F.lit("line:"), s)))
    return found


def grounded_share(names: Column, text: Column) -> Column:
    """The share of names that occur in a text; null without names."""
    return F.try_divide(F.size(F.filter(names, lambda a: occurs_in(a, text))), F.size(names))


def is_grounded(x: C, text: Column, least: float = 0.5) -> Column:
    """Whether at least half of a text's anchors occur in another; without anchors it is."""
    return F.coalesce(grounded_share(anchors(x), text) >= least, F.lit(True))


def probe_gate(corrects: Column, names: Column, text: Column) -> Column:
    """A correction all of whose anchors are out of sight."""
    return corrects & (F.size(names) > 0) & ~F.exists(names, lambda a: occurs_in(a, text))


def same_or_cut(a: Column, b: Column, least: int = 250) -> Column:
    """Equal after fold_key, or one the beginning of the other with both at least `least` characters long."""
    x, y = fold_key(a), fold_key(b)
    cut = (F.least(F.length(x), F.length(y)) >= least) & (x.startswith(y) | y.startswith(x))
    return (x != "") & ((x == y) | cut)


def test_tokens(names: Column, last_segment: bool = True) -> Column:
    """Tokens that give hidden tests away: test_* and Test* names, and titles of sentences; longest first, then by name.

    last_segment looks only behind the last `::`, as the file before it is no secret.
    """
    part = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.element_at(F.split(n, "::"), -1) if last_segment else n)
    snake = F.flatten(F.transform(part, lambda n: F.regexp_extract_all(n, F.lit(r"\btest_[A-Za-z0-9_]{3,}\b"), F.lit(0))))
    camel = F.flatten(F.transform(part, lambda n: F.regexp_extract_all(n, F.lit(r"\bTest[A-Z][A-Za-z0-9_]{2,}\b"), F.lit(0))))
    titles = F.filter(F.transform(part, strip), lambda n: F.contains(n, F.lit(" ")) & (F.length(n) >= 15))
    return longest_first(F.array_union(F.array_union(snake, camel), titles))


def longest_first(xs: Column) -> Column:
    keyed = F.transform(F.array_distinct(xs), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def secret_tokens(solution: Column, told: Column, common: Sequence[str] = ()) -> Column:
    """Identifiers and paths of a solution that its task doesn't tell, common words aside; longest first."""
    names = F.array_union(_all(solution, r"\b[A-Za-z_][A-Za-z0-9_.-]{5,}\b"), _all(solution, r"/[\w./-]{6,}"))
    return longest_first(F.filter(names, lambda n: ~F.lower(n).isin(list(common) or [""]) & ~occurs_in(n, told)))


def hidden_values(outputs: Column, told: Column, least: int = 3) -> Column:
    """Hidden outputs that the public text doesn't show."""
    return F.filter(F.transform(outputs, strip), lambda v: (F.length(v) >= least) & ~occurs_in(v, told))


def quoted(token: Column) -> Column:
    """A token as a literal pattern, with word borders only where it begins or ends with a letter or digit."""
    edge = lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), r"\b").otherwise("")
    literal = F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(edge(F.substring(token, 1, 1)), literal, edge(F.substring(token, -1, 1)))


def leaked_tokens(text: Column, tokens: Column) -> Column:
    """The tokens that occur as words of their own."""
    return F.filter(tokens, lambda t: F.coalesce(F.regexp_like(text, quoted(t)), F.lit(False)))


def redact(text: Column, tokens: Column, by: str = "[hidden test]") -> Column:
    """The text with each token replaced, longest first, so that parts never clip a whole."""
    return F.aggregate(longest_first(tokens), text, lambda acc, t: F.regexp_replace(acc, quoted(t), F.lit(by.replace("$", r"\$"))))


def redactions(text: Column, tokens: Column) -> Column:
    """How many places `redact` replaces."""
    start = F.struct(text.alias("t"), F.lit(0).alias("n"))
    step = lambda acc, t: F.struct(F.regexp_replace(acc["t"], quoted(t), F.lit("\u0001")).alias("t"), (acc["n"] + F.regexp_count(acc["t"], quoted(t))).alias("n"))
    return F.aggregate(longest_first(tokens), start, step)["n"]


def rewrite_phrases(x: C, phrases: Sequence[tuple[str, str]] = fixed.PHRASES, guards: Mapping[str, str] = fixed.PRODUCTS) -> Column:
    """Phrases replaced in their order, whatever their case; the first letter keeps its case."""
    out = _c(x)
    for phrase, to in phrases:
        guard = guards.get(phrase, r"\b")
        rest = f"(?i:\\Q{phrase[1:]}\\E)" if len(phrase) > 1 else ""
        for first, target in ((phrase[0].upper(), to[0].upper() + to[1:]), (phrase[0], to)):
            out = F.regexp_replace(out, f"\\b{first}{rest}(?i:{guard})" if guard != r"\b" else f"\\b{first}{rest}\\b", target)
    return out


def neutral_words(x: C) -> Column:
    """`redirect` and its forms become `turn`, `oracle` becomes `analysis`, whatever their case."""
    out = _c(x)
    for pattern, to in ((r"redirected", "turned"), (r"redirecting", "turning"), (r"redirect(?:ion)?", "turn"), (r"the oracle", "the analysis"), (r"oracle", "analysis")):
        out = F.regexp_replace(out, rf"(?i)\b{pattern}\b", to)
    return out


def soften_redirect(x: C) -> Column:
    """Only `redirect` as a verb of attention becomes `turn`; the noun of the web stays."""
    # one pass for each form, as a replacement can't choose
    out = _c(x)
    for ending, turn in fixed.TURNS.items():
        out = F.regexp_replace(out, rf"(?i)\bredirect{ending}\b{fixed.ATTENTION}", turn)
    for ending in ("", "ed"):
        out = F.regexp_replace(out, rf"(?i)\b{fixed.PERFECT}redirect{ending}\b", f"$1{fixed.TURNS[ending]}")
    return out


def labels_in_order(x: C, labels: Sequence[str] = fixed.LABELS) -> Column:
    """The labels that begin a line, by their first place in the text."""
    t = text_or_empty(x)
    found = F.array(*[F.when(t.rlike(rf"(?m)^\Q{a}\E:"), F.struct(F.instr(t, f"{a}:").alias("at"), F.lit(a).alias("x"))) for a in labels])
    return F.transform(F.array_sort(F.array_compact(found)), lambda s: s["x"])


def rename_labels(x: C, names: Mapping[str, str]) -> Column:
    """The labels that begin a line under other names, longest first; the last line end is dropped."""
    def one(line: Column) -> Column:
        out = F.when(F.lit(False), line)
        for a, b in sorted(names.items(), key=lambda p: -len(p[0])):
            out = out.when(line.startswith(a + ":"), F.concat(F.lit(b), F.substr(line, F.lit(len(a) + 1))))
        return out.otherwise(line)

    return F.array_join(F.transform(F.split(F.regexp_replace(text_or_empty(x), r"\R\z", ""), r"\R"), one), "\n")


def schema_note(labels: Column, names: Mapping[str, str]) -> Column:
    """The sentence that asks for given labels in their order; empty without labels."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv]) if names else None
    said = labels if table is None else F.transform(labels, lambda a: F.coalesce(F.try_element_at(table, a), a))
    return F.when(F.size(labels) > 0, F.concat(F.lit("\n\nUse exactly these section labels, in this order: "), F.array_join(said, " / "), F.lit("."))).otherwise("")


def section(x: C, start: str, end: str | None = None) -> Column:
    """What stands between two patterns (to the end without the second); empty where the first isn't found."""
    stop = rf"(?:{end}|\z)" if end else r"\z"
    return F.regexp_extract(text_or_empty(x), rf"(?s){start}(.*?){stop}", 1)


def before(x: C, pattern: str) -> Column:
    """What stands before the first match of a pattern; all where there is none."""
    return F.split(text_or_empty(x), pattern, 2)[0]


def one_line_hypothesis(x: C, width: int = 400) -> Column:
    """The first HYPOTHESIS line, else the beginning of the whole text, as one line."""
    found = F.regexp_extract(text_or_empty(x), r"(?i)HYPOTHESIS:\s*(.+)", 1)
    return F.when(found != "", normalise_line(found)).otherwise(F.substring(normalise_line(x), 1, width))


def last_hypothesis(x: C, width: int = 300) -> Column:
    return F.substring(strip(F.coalesce(F.try_element_at(_all(x, r"HYPOTHESIS:\s*(.+)", 1), F.lit(-1)), F.lit(""))), 1, width)


def middle_cut(x: C, width: int, mark: str = "\n... [output truncated] ...\n") -> Column:
    """Both halves of a text longer than width."""
    half = width // 2
    return F.when(F.length(x) <= width, _c(x)).otherwise(F.concat(F.substring(x, 1, half), F.lit(mark), F.substring(_c(x), -half, half)))


def elide_lines(x: C, keep: int, total: int) -> Column:
    """Long lines cut in their middle with a note of what is gone, and the whole cut likewise."""
    def one(s: Column) -> Column:
        gone = F.concat(F.lit("...<"), F.format_number(F.length(s) - keep, 0), F.lit(" chars>..."))
        return F.when(F.length(s) <= keep, s).otherwise(F.concat(F.substring(s, 1, keep // 2), gone, F.substring(s, -(keep - keep // 2), keep - keep // 2)))

    lines = F.array_join(F.transform(F.split(text_or_empty(x), "\n"), one), "\n")
    return F.when(F.length(lines) <= total, lines).otherwise(F.concat(F.substring(lines, 1, total), F.lit("\n...<"), F.format_number(F.length(lines) - total, 0), F.lit(" chars>")))


def judged_output(x: C) -> Column:
    """Output as a judge compares it: ends stripped, each line's end too."""
    return F.array_join(F.transform(F.split(strip(text_or_empty(x)), r"\R"), lambda s: F.regexp_replace(s, r"\s+$", "")), "\n")


def problem_id(x: C, prefix: str = "lcb__") -> Column:
    return F.concat(F.lit(prefix), F.translate(x, "/ ", "__"))


def image_name(instance_id: C, width: int = 128) -> Column:
    """A container tag: lower case, without `instance_` and a trailing `-vnan`, cut to width."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(instance_id), "^instance_", ""), "-vnan$", ""), 1, width)


def token_estimate(*xs: C, per: float = 3.5) -> Column:
    total = F.lit(0)
    for x in xs:
        total = total + F.length(text_or_empty(x))
    return total / F.lit(per)


def flat_content(x: C, joiner: str = "\n") -> Column:
    """Message content as text: a string, or parts (strings or objects with text or content) joined."""
    v = F.try_parse_json(x)
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.content", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))
    parts = F.try_variant_get(v, "$", "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), joiner)).when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), F.when(F.schema_of_variant(v).startswith("OBJECT"), part(v)).otherwise(F.try_variant_get(v, "$", "string"))).otherwise(text_or_empty(x))


def json_object(x: C, schema: str) -> Column:
    """An object from text that may have fences or prose around it; null where none parses."""
    bare = strip(F.regexp_replace(strip(text_or_empty(x)), r"(?m)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(ok(bare), ok(inner))


def literal_list(x: C, strict: bool = True) -> Column:
    """An array of strings from JSON, else from a Python list, tuple or set literal; null and blank texts give none.

    What parses as neither raises, so that a wall made of such lists never stands open; with strict off it gives none.
    Only what isn't JSON goes through Python.
    """
    said, read = _c(x), F.from_json(x, "array<string>")
    rest = F.when(read.isNull() & (strip(text_or_empty(said)) != ""), said)
    return F.coalesce(read, python_list(rest, strict), F.array().cast("array<string>"))


def last_of_key(entries: Column, key: str) -> Column:
    """A map from an array of (key, value) structs; of equal keys the last one wins, null keys are left out."""
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o[key].eqNullSafe(e[key]))
    return F.map_from_entries(F.filter(entries, lambda e, i: e[key].isNotNull() & ~later(e, i)))


def crlf_to_lf(data: Column, window: int = 8192) -> Column:
    """CRLF as LF in text; what has a zero byte early is binary and stays."""
    head = F.hex(F.substring(data, 1, window))
    binary = F.exists(F.transform(F.sequence(F.lit(0), F.greatest(F.length(head) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.substring(head, i * 2 + 1, F.lit(2))), lambda b: b == "00")
    return F.when(binary, data).otherwise(F.encode(F.replace(F.decode(data, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1"))


def split_lines_by(x: C, mark: str) -> tuple[Column, Column]:
    """The lines that hold a mark, and the others; blank lines are left out of both."""
    lines = F.filter(F.split(text_or_empty(x), r"\R"), lambda s: strip(s) != "")
    return F.filter(lines, lambda s: F.contains(s, F.lit(mark))), F.filter(lines, lambda s: ~F.contains(s, F.lit(mark)))


def last_n(xs: Column, n: int) -> Column:
    """The last n elements, all of a shorter array."""
    return F.slice(xs, F.greatest(F.lit(1), F.size(xs) - n + 1), F.lit(n))


def head_and_tail(xs: Column, n: int) -> Column:
    """The first and last elements, n in all, of a longer array."""
    head, tail = n // 2, n - n // 2
    return F.when(F.size(xs) <= n, xs).otherwise(F.concat(F.slice(xs, 1, head), F.slice(xs, F.greatest(F.lit(1), F.size(xs) - tail + 1), F.lit(tail))))


def bullets(xs: Column, lead: str = "- ") -> Column:
    return F.array_join(F.transform(xs, lambda s: F.concat(F.lit(lead), s)), "\n")


def titled(title: str, body: Column) -> Column:
    """A headed block, nothing for an empty body."""
    return F.when(text_or_empty(body) != "", F.concat(F.lit(title + "\n"), body))


def ladder(x: C, ordinals: Mapping[str, int], default: int | None = 0) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, n in ordinals.items():
        out = out.when(_c(x) == name, n)
    return out if default is None else out.otherwise(default)


def map_with_prefix(x: C, table: Mapping[str, str], prefixes: Mapping[str, str], default: str) -> Column:
    """A looked-up value, else that of the first prefix that fits, else the default."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(_c(x) == k, v)
    for k, v in prefixes.items():
        out = out.when(_c(x).startswith(k), v)
    return out.otherwise(default)


def fold_over(x: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    for f in steps:
        x = f(x)
    return x
