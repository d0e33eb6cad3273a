"""Texts put together from arrays and structs: evidence, transcripts, feedback and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajecta.functions import text as T


def evidence(tests: Column, edits: Column, found: Column, inspected: Column, none: str = "(exploration / reading only)") -> Column:
    """Evidence of a card as lines: tests (cmd and result, the result cut), edits (cut), hits and files; a default without any."""
    ran = lambda t: F.concat(F.lit("- ran test `"), t["cmd"], F.lit("`"), F.when(T.truthy(t["result"]), F.concat(F.lit(" -> "), F.substring(t["result"], 1, 160))).otherwise(""))
    lines = F.concat(
        F.transform(tests, ran),
        F.transform(edits, lambda e: F.concat(F.lit("- edited: "), F.substring(e, 1, 600))),
        F.transform(found, lambda h: F.concat(F.lit("- found: "), h)),
        F.when(F.size(inspected) > 0, F.array(F.concat(F.lit("- inspected: "), F.array_join(inspected, ", ")))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(none)


def transcript(messages: Column, width: int, role: str = "role", content: str = "content") -> Column:
    """Messages as `[role] text`: the assistant's whole, the others' (observations) cut to width."""
    said = lambda m: F.when(F.lower(m[role]) == "assistant", T.text_or_empty(m[content])).otherwise(F.substring(T.text_or_empty(m[content]), 1, width))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), T.text_or_empty(m[role]), F.lit("] "), said(m))), "\n")


def digest(items: Column, lead: str, none: str) -> Column:
    """A numbered list, or a text for an empty one."""
    numbered = F.transform(items, lambda x, i: F.concat(F.lit(lead), (i + 1).cast("string"), F.lit(": "), x))
    return F.when(F.size(items) > 0, F.array_join(numbered, "\n")).otherwise(none)


def feedback(failures: Column, hidden: Column, most: int = 3, width: int = 120, tail: int = 2500) -> Column:
    """The first failures, each cut, and how many hidden ones there are besides; the end of it where it is too long."""
    shown = F.transform(F.slice(failures, 1, most), lambda f: F.concat(F.lit("FAILED "), F.substring(f, 1, width)))
    said = F.array_join(F.array_append(shown, F.concat(F.lit("hidden failures: "), hidden.cast("string"))), "\n")
    return F.right(said, F.lit(tail))


def prompt(blocks: Sequence[tuple[str, Column]], ask: str) -> Column:
    """Headed blocks, empty ones left out, and a question, with blank lines between."""
    return F.concat_ws("\n\n", *[T.titled(title, body) for title, body in blocks], F.lit(ask))


def hit_places(messages: Column, needles: Sequence[str], content: str = "content") -> Column:
    """The places (from 0) of the messages that hold any of the fixed texts."""
    marked = F.transform(messages, lambda m, i: F.when(T.contains_any(m[content], needles), i))
    return F.array_compact(marked)


def fingerprint(lines: Column) -> Column:
    """MD5 over sorted lines, whatever their order."""
    return F.md5(F.array_join(F.array_sort(lines), "\n").cast("binary"))


def smallest(items: Column, fails: Column, size: Column) -> Column:
    """Of parallel arrays, the failing item of the least size, the first on ties; null if none fails."""
    zipped = F.transform(items, lambda x, i: F.struct(F.element_at(size, i + 1).alias("n"), i.alias("i"), x.alias("x"), F.element_at(fails, i + 1).alias("f")))
    return F.array_min(F.filter(zipped, lambda s: s["f"]))["x"]
