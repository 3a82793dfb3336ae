"""Cutting oversized items at natural boundaries (problem 4).

A text's boundaries (blank lines, line ends, sentence ends, blanks) are sorted arrays of character
offsets with a prefix sum of line feeds beside them. The next cut is the last boundary of the best
kind under the limit, found by binary search; the next piece starts at the boundary nearest to
`overlap` characters before the cut; where there is no boundary the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.vocabulary import encoding, shipped
from lodeseek.session import staged

LIMIT, OVERLAP, BUCKET = 2048, 200, 4096
# Offsets after which a text may be cut, best kind first.
_KINDS = (re.compile(r"\n[ \t\r]*\n"), re.compile(r"\n"), re.compile(r"[.!?;。！？][\"')\]」]*\s+|[。！？]"), re.compile(r"\s+|(?<=[,;{}()\[\]])(?=\S)"))
# A cut of a kind is taken only if the piece keeps this share of the limit; otherwise a finer kind is tried.
_FILL = (0.6, 0.5, 0.5, 0.3)


class Piece(NamedTuple):
    begin: int
    end: int  # characters of the text
    first_line: int  # counted from 0 within the text
    last_line: int


def _keeps_together(text: str, at: int) -> bool:
    """Whether a cut before `at` would part what belongs together: CR from LF, a base from its marks, joined signs."""
    a, b = text[at - 1], text[at]
    return (a == "\r" and b == "\n") or a == "‍" or b == "‍" or 0x300 <= ord(b) <= 0x36F or 0xFE00 <= ord(b) <= 0xFE0F or 0x1F3FB <= ord(b) <= 0x1F3FF


def token_ends(text: str, encoding) -> np.ndarray:  # noqa: ANN001
    """The character offset at which each token of the text ends, as sorted prefix sums; tokens that end within one character end where it does."""
    starts = encoding.decode_with_offsets(encoding.encode_ordinary(text))[1]
    return np.append(np.asarray(starts[1:], np.int64), len(text)) if starts else np.zeros(0, np.int64)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, ends: np.ndarray | None = None) -> list[Piece]:
    """Pieces of at most `limit` characters that cover the text, each starting about `overlap` before the end of the one before.

    With `ends` (see `token_ends`) limit and overlap count tokens of the whole text instead; a character
    that has more tokens than the limit is a piece by itself.
    """
    n = len(text)
    if ends is not None:
        if len(ends) <= limit:
            feeds = text.count("\n", 0, max(0, n - 1))
            return [Piece(0, n, 0, feeds)]
        return _split(text, lambda b: max(b + 1, int(ends[min(int(np.searchsorted(ends, b, side="right")) + limit, len(ends)) - 1])), lambda e: int(ends[max(int(np.searchsorted(ends, e, side="left")) - overlap, 0)]))
    if n <= limit:
        return [Piece(0, n, 0, text.count("\n", 0, max(0, n - 1)))]
    return _split(text, lambda b: b + limit, lambda e: e - overlap)


def _split(text: str, reach, back) -> list[Piece]:  # noqa: ANN001
    """Pieces, where one that begins at b may end at reach(b) and the next begins near back(end)."""
    n = len(text)
    feeds = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
    lines = lambda at: int(np.searchsorted(feeds, at))  # noqa: E731  # line feeds before an offset
    bounds = [np.fromiter((m.end() for m in rx.finditer(text)), np.int64) for rx in _KINDS]
    every = np.unique(np.concatenate(bounds))
    out, begin = [], 0
    while True:
        top = min(reach(begin), n)
        overlap = top - back(top)
        if top == n:
            end = n
        else:
            end = 0
            for b, fill in zip(bounds, _FILL, strict=True):
                k = int(np.searchsorted(b, top, side="right")) - 1
                if k >= 0 and b[k] >= begin + max(overlap + 1, fill * (top - begin)):
                    end = int(b[k])
                    break
            if not end:
                end = top
                low = max(begin + min(overlap + 1, top - begin), end - 16)
                while end > low and _keeps_together(text, end):
                    end -= 1
        out.append(Piece(begin, end, lines(begin), lines(end - 1)))
        if end == n:
            return out
        target = max(back(end), begin + 1)
        overlap = end - target
        k = int(np.searchsorted(every, target))
        near = [int(every[i]) for i in (k - 1, k) if 0 <= i < len(every) and begin < every[i] < end and abs(int(every[i]) - target) <= overlap // 2]
        after = min(near, key=lambda x: abs(x - target)) if near else max(begin + 1, target)
        while not near and after > begin + 1 and _keeps_together(text, after):
            after -= 1
        begin = after


_PIECES = "piece int, pieces int, begin int, text string, first_line int, last_line int"


def split_oversized(chunks: DataFrame, id: str = "id", path: str = "file_path", index: str = "chunk_index", text: str = "chunk_text", start_line: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None) -> DataFrame:
    """Every chunk as pieces of at most `limit` characters (code points), renumbered within its file.

    Result: id, file_path, chunk_index (fresh, from 0 within the file), chunk_text, start_line, end_line,
    piece (from 0), pieces (how many the chunk gave) and begin (the piece's first character in the
    chunk). With `vocabulary` (the file of a public tokenizer's ranks) limit and overlap count its tokens.
    A chunk within the limit is one piece, as it is. Repeated rows count once. A null text gives
    one piece with null text; an empty text one empty piece; a null start line gives null lines; null
    ids are left out; rows with one id but another path or index are different chunks. An empty table
    gives an empty result.

    Only oversized texts go through Python, once. Numbering is by prefix sums over blocks of 4,096 old
    indexes, so a file with a third of all rows is not sorted in one task; rows are shuffled once.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    rows = chunks.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{path}`").alias("file_path"), F.col(f"`{index}`").cast("long").alias("old"), F.col(f"`{text}`").alias("text"), F.col(f"`{start_line}`").cast("int").alias("line")
    ).where("id is not null")
    # A text of few bytes has few tokens; which of the others are short enough is found out where they are cut.
    long = F.coalesce(F.length("text") if vocabulary is None else F.octet_length("text"), F.lit(0)) > limit
    whole = rows.where(~long).select("id", "file_path", "old", "line", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("begin"), "text", F.lit(0).alias("first_line"), _last_line().alias("last_line"))

    ranks = shipped(chunks.sparkSession, vocabulary) if vocabulary else None

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                parts = split_text(r.text, limit, overlap, token_ends(r.text, encoding(ranks.value)) if ranks else None)
                out += [(r.id, r.file_path, r.old, r.line, k, len(parts), p.begin, r.text[p.begin : p.end], p.first_line, p.last_line) for k, p in enumerate(parts)]
            x = pd.DataFrame(out, columns=[*b.columns[:3], "line", "piece", "pieces", "begin", "text", "first_line", "last_line"])
            yield x.astype({"line": "Int32", "old": "Int64"})

    kind = dict(rows.dtypes)["id"]
    cut = rows.where(long).select("id", "file_path", "old", "line", "text").mapInPandas(op, f"id {kind}, file_path string, old bigint, line int, {_PIECES}")
    cut = staged(cut, "pieces")
    return _renumber(whole.unionByName(cut)).select(
        "id", "file_path", F.col("fresh").cast("int").alias("chunk_index"), F.col("text").alias("chunk_text"), (F.col("line") + F.col("first_line")).alias("start_line"), (F.col("line") + F.col("last_line")).alias("end_line"), "piece", "pieces", "begin"
    )


def _last_line():  # noqa: ANN202
    """Line feeds before a text's last character."""
    t = F.col("text")
    return F.coalesce(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) - F.when(t.endswith("\n"), 1).otherwise(0), F.lit(0))


def _renumber(pieces: DataFrame) -> DataFrame:
    """`fresh`: the place of each piece in its file, by old index, id and piece; null indexes come last, dealt over blocks by a hash of the id."""
    late = F.lit(2**40) + F.pmod(F.xxhash64("id"), F.lit(1024))
    tagged = pieces.withColumn("block", F.when(F.col("old").isNull(), late).otherwise(F.floor(F.col("old") / BUCKET)))
    sums = tagged.groupBy("file_path", "block").agg(F.count_distinct(F.coalesce("old", F.lit(2**40)), "id", "piece").alias("n"))
    before = sums.select(F.col("file_path").alias("f"), F.col("block").alias("b"), (F.sum("n").over(Window.partitionBy("file_path").orderBy("block")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("file_path", "block").orderBy(F.col("old").asc_nulls_last(), "id", "piece")
    copy = Window.partitionBy("file_path", "block", "old", "id", "piece").orderBy("begin")
    numbered = tagged.withColumns({"place": F.dense_rank().over(inside), "copy": F.row_number().over(copy)}).where("copy = 1")
    joined = numbered.join(before, F.col("file_path").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")))
    return joined.withColumn("fresh", F.col("before") + F.col("place") - 1)
