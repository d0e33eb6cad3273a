"""Problem 7: texts as ids of a public byte-level BPE, by a monoid tree reduction."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.session import parallelism, spread

#: Where the vocabulary files lie, and which of them counts.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
#: Fixed value: how this vocabulary's public tokenizer splits text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place that no pre-token of PATTERN crosses: common white space behind something else (Python's \S is narrower than
#: the tokenizer's, so that what it takes for something else is so for both), and, for scripts without blanks, a mark or
#: digit behind a letter, as no alternative takes either after a letter. Only letters and marks of any Unicode version.
_SAFE = re.compile(r"(?<=\S)[ \t\n\r]|(?<=[ぁ-ゖァ-ヺ㐀-䶵一-鿋가-힣])[、。，．！？；：（）「」『』…·!-@\[-`{-~]")


@lru_cache(maxsize=2)
def encoder(folder: str, name: str):
    """tiktoken's encoder for <folder>/<name>.tiktoken, once in a worker; where the folder is missing, the file sent along."""
    import tiktoken

    path = f"{folder}/{name}.tiktoken"
    with open(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file if x.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Piece:
    """A stretch of text in the tokenisation monoid: open head, settled ids, open tail.

    Between two safe cuts (before white space that follows something else) no pre-token crosses a border, as no
    alternative of PATTERN takes white space after another character, and none looks behind. The ids between two
    safe cuts are therefore final whatever stands around them. Without two cuts everything stays open text (head).
    """

    __slots__ = ("head", "ids", "tail")

    def __init__(self, head: str, ids: list[np.ndarray] | None = None, tail: str = "") -> None:
        self.head, self.ids, self.tail = head, ids, tail


def leaf(text: str, enc) -> Piece:
    """A short stretch, encoded between its first and last safe cut."""
    first = _SAFE.search(text)
    if first is None:
        return Piece(text)
    last = first.start()
    for m in _SAFE.finditer(text, max(first.start(), len(text) - 400)):
        last = m.start()
    if last == first.start():
        for m in _SAFE.finditer(text, first.start()):
            last = m.start()
    ids = enc.encode_ordinary(text[first.start() : last]) if last > first.start() else []
    return Piece(text[: first.start()], [np.array(ids, dtype=np.int32)], text[last:])


def join(a: Piece, b: Piece, enc) -> Piece:
    """Neighbours joined: only the window between the outer safe cuts is encoded again.

    Where a side has no cut the window grows by all of it. The seam itself may become a cut.
    """
    if a.ids is None and b.ids is None:
        seam = a.head + b.head
        cut_ = _SAFE.search(seam, max(0, len(a.head) - 1), len(a.head) + 1)
        return leaf(seam, enc) if cut_ else Piece(seam)
    if a.ids is None:
        return _opened(a.head + b.head, b.ids, b.tail, len(a.head), enc)
    if b.ids is None:
        window = a.tail + b.head
        p = leaf(window, enc)
        # a.tail starts at a safe cut, so what lies before the window's own first cut is settled as well
        if p.ids is None:
            return Piece(a.head, a.ids, window)
        return Piece(a.head, [*a.ids, np.array(enc.encode_ordinary(p.head), dtype=np.int32), *p.ids], p.tail)
    window = np.array(enc.encode_ordinary(a.tail + b.head), dtype=np.int32)
    return Piece(a.head, [*a.ids, window, *b.ids], b.tail)


def _opened(head: str, ids: list[np.ndarray], tail: str, seam: int, enc) -> Piece:
    """A new head that may hold a cut at its seam; what follows the cut is settled."""
    m = _SAFE.search(head, max(0, seam - 1), seam + 1)
    if m is None:
        return Piece(head, ids, tail)
    return Piece(head[: m.start()], [np.array(enc.encode_ordinary(head[m.start() :]), dtype=np.int32), *ids], tail)


def reduce_tree(text: str, enc, width: int) -> Piece:
    """Halves are encoded recursively down to `width` characters, then joined up the tree."""
    if len(text) <= width:
        return leaf(text, enc)
    half = len(text) // 2
    return join(reduce_tree(text[:half], enc, width), reduce_tree(text[half:], enc, width), enc)


def close(p: Piece, enc) -> np.ndarray:
    """The root's ids: its open ends are the ends of the text, where they settle."""
    if p.ids is None:
        return np.array(enc.encode_ordinary(p.head), dtype=np.int32)
    return np.concatenate([np.array(enc.encode_ordinary(p.head), dtype=np.int32), *p.ids, np.array(enc.encode_ordinary(p.tail), dtype=np.int32)])


def encode(text: str | None, enc, width: int = 1 << 14) -> np.ndarray:
    """All ids of one text; none for empty and null texts."""
    return close(reduce_tree(text, enc, width), enc) if text else np.empty(0, dtype=np.int32)


def decode(parts: list[np.ndarray], enc) -> str:
    """The text of ids, concatenated as bytes, so that characters split over parts come together."""
    return b"".join(enc.decode_bytes(x.tolist()) for x in parts).decode("utf-8", errors="replace")


def encode_corpus(
    docs: DataFrame, row_id: str, text: str, *, lengths: bool = False, folder: str = TOKENIZERS, name: str = VOCABULARY, width: int = 1 << 14, chunk: int = 1 << 18
) -> DataFrame:
    """(row_id, `ids`), or (row_id, `n_tokens`) with lengths: every text, whole, without special tokens.

    Null and empty texts give an empty list (0); strings of special tokens are ordinary text; one row comes out for
    each row that goes in, repeated row_ids included. Texts up to `chunk` characters are encoded where they are
    scanned, by the tree of halves down to `width` characters. Longer ones are cut into chunks that many tasks encode
    as leaves of the same monoid, and the chunks of a text are joined in the tree order by one task, which holds no
    more than the row that it returns. Other columns don't matter.
    """
    docs.sparkSession.sparkContext.addFile(f"{folder}/{name}.tiktoken")  # executors need no such folder
    out = f"{row_id} {dict(docs.dtypes)[row_id]}, " + ("n_tokens bigint" if lengths else "ids array<int>")
    slim = docs.select(F.col(row_id), F.coalesce(text, F.lit("")).alias("__text"))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for b in batches:
            ids = [encode(x, enc, width) for x in b["__text"]]
            yield pd.DataFrame({row_id: b[row_id], **({"n_tokens": [len(x) for x in ids]} if lengths else {"ids": ids})})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for b in batches:
            ps = [reduce_tree(x, enc, width) for x in b["__text"]]
            ids = [None if p.ids is None else np.concatenate(p.ids) for p in ps]
            yield pd.DataFrame({"__row": b["__row"], row_id: b[row_id], "__at": b["__at"], "head": [p.head for p in ps], "ids": ids, "tail": [p.tail for p in ps]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(folder, name)
        pdf = pdf.sort_values("__at")
        ps = [Piece(h, None if i is None else [np.asarray(i, dtype=np.int32)], t) for h, i, t in zip(pdf["head"], pdf["ids"], pdf["tail"])]
        while len(ps) > 1:
            ps = [join(*ps[i : i + 2], enc) if i + 1 < len(ps) else ps[i] for i in range(0, len(ps), 2)]
        ids = close(ps[0], enc)
        return pd.DataFrame({row_id: pdf[row_id].iloc[:1].tolist(), **({"n_tokens": [len(ids)]} if lengths else {"ids": [ids]})})

    near = spread(slim.filter(F.length("__text") <= chunk)).mapInPandas(short, out)
    starts = F.sequence(F.lit(0), F.expr(f"(length(__text) - 1) div {chunk}"))
    far = slim.filter(F.length("__text") > chunk).withColumn("__row", F.monotonically_increasing_id())
    far = far.select("__row", row_id, F.posexplode(F.transform(starts, lambda i: F.substring("__text", i * chunk + 1, F.lit(chunk)))).alias("__at", "__text"))
    far = far.repartition(parallelism(docs.sparkSession), "__row", "__at")
    far = far.mapInPandas(chunks, f"__row bigint, {row_id} {dict(docs.dtypes)[row_id]}, __at int, head string, ids array<int>, tail string")
    return near.union(far.groupBy("__row").applyInPandas(whole, out))
