"""One form for text that looks the same (problem 10).

Arrow text is copied into one code-point array per batch. Lookup tables give each code point the
length and place of its replacement; a gather with expansion offsets writes the new array; marks are
then sorted and composed on the whole array. No string function runs per row.

What is folded: full- and half-width forms, ligatures, Roman-numeral signs, every kind of blank,
hyphens that are drawn like the ASCII one, invisible characters, canonical equivalents, carriage
returns before a line feed, and letters of other scripts that are drawn like Latin ones. What a
reader can see stays: accents, letter case, digits, raised digits, dashes of another length, and
joiners that change how an emoji or a joining script is drawn.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.session import staged

# Letters drawn like the Latin letter below them.
_CYRILLIC = "аеорсухіјѕԁһԛԝӏ" + "АВЕКМНОРСТУХІЈЅԌԚԜҮ"
_CYRILLIC_LATIN = "aeopcyxijsdhqwl" + "ABEKMHOPCTYXIJSGQWY"
_GREEK = "ονϲϳ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
_GREEK_LATIN = "ovcj" + "ABEZHIKMNOPTYXCJ"
_OTHER = "օՕոհցՍɡ"
_OTHER_LATIN = "oOnhgUg"
_COPTIC = "ⲟⲣⲥⲭⲞⲢⲤⲔⲎⲘⲚⲦⲂⲬⲨⲒ"
_COPTIC_LATIN = "opcxOPCKHMNTBXYI"
_CHEROKEE = "ᎪᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏴ"
_CHEROKEE_LATIN = "ACDEGHJKLMPRSTVWZB"
_LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
_LISU_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
# Signs drawn like an ASCII one.
_HYPHENS = "‐‑"
_INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Ranges whose compatibility decomposition is drawn like the sign itself.
_LIKE_THEIR_PARTS = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
_DRAWN_ALIKE = dict(zip(_CYRILLIC + _GREEK + _OTHER + _COPTIC + _CHEROKEE + _LISU + _HYPHENS, _CYRILLIC_LATIN + _GREEK_LATIN + _OTHER_LATIN + _COPTIC_LATIN + _CHEROKEE_LATIN + _LISU_LATIN + "--", strict=True))
# Ranges of selectors and tags that nothing is drawn for. Tags after a flag choose the flag and stay.
_UNDRAWN = ((0xFE00, 0xFE0D), (0xE0001, 0xE007F), (0xE0100, 0xE01EF))
_FLAG, _TAGS = 0x1F3F4, (0xE0020, 0xE007F)

_TOP = 0x110000
_ZWNJ, _ZWJ, _CR, _LF = 0x200C, 0x200D, 0x0D, 0x0A
_L0, _V0, _T0, _S0 = 0x1100, 0x1161, 0x11A7, 0xAC00


class _Tables:
    """Lookup tables over all code points, built once per Python worker."""

    def __init__(self) -> None:
        self.size = np.ones(_TOP, np.uint8)
        self.at = np.arange(_TOP, dtype=np.int32)
        self.rank = np.zeros(_TOP, np.uint8)  # canonical combining class
        self.joins = np.zeros(_TOP, bool)  # a joiner next to it can be seen
        self.changes = np.zeros(_TOP, bool)  # a text without such a sign is in the one form already
        extra: list[int] = []
        pairs: list[tuple[int, int, int]] = []
        invisible = set(_INVISIBLE)
        undrawn = {c for a, b in _UNDRAWN for c in range(a, b + 1)}
        for c in (*range(0x30000), *range(0xE0000, 0xE0200)):
            if 0xD800 <= c < 0xE000 or _S0 <= c < _S0 + 11172:
                continue
            ch = chr(c)
            self.rank[c] = unicodedata.combining(ch)
            rule = unicodedata.decomposition(ch)
            if ch in invisible or c in undrawn:
                parts = ""
            elif unicodedata.category(ch) == "Zs":
                parts = " "
            elif rule.startswith(("<wide>", "<narrow>")) or (rule.startswith("<compat>") and any(a <= c <= b for a, b in _LIKE_THEIR_PARTS)):
                parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
            elif rule and rule[0] != "<":
                parts = unicodedata.normalize("NFD", ch)
                if len(rule.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
                    pairs.append((*(int(x, 16) for x in rule.split()), c))
            else:
                parts = ch
            parts = "".join(_DRAWN_ALIKE.get(x, x) for x in parts if x not in invisible)
            if parts != ch:
                self.size[c] = len(parts)
                self.at[c] = _TOP + len(extra)
                extra += map(ord, parts)
                self.changes[c] = unicodedata.normalize("NFC", parts) != ch
        self.pool = np.concatenate([np.arange(_TOP, dtype=np.uint32), np.asarray(extra, np.uint32)])
        first, second, whole = (np.asarray(x, np.uint64) for x in zip(*pairs, strict=True))
        order = np.argsort(first << 32 | second)
        self.pair, self.whole = (first << 32 | second)[order], whole[order].astype(np.uint32)
        self.composes = np.zeros(_TOP, bool)
        self.composes[second.astype(np.int64)] = True
        self.composes[_V0 : _T0 + 28] = True
        self.changes |= (self.rank > 0) | self.composes
        self.changes[_CR] = True
        for a, b in ((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x1000, 0x109F), (0x1780, 0x18AF), (0x2190, 0x21FF), (0x231A, 0x23FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF), (0xFE0E, 0xFE0F)):
            self.joins[a : b + 1] = True


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


def _drop(cp: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([[0], np.cumsum(gone)])
    return cp[~gone], offsets - before[offsets]


def _compose(cp: np.ndarray, offsets: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Sort marks by combining class and join each with its base where one sign exists for both."""
    rank = t.rank[cp]
    if ((rank[1:] > 0) & (rank[:-1] > rank[1:])).any():
        segment = np.cumsum((rank == 0) | np.isin(np.arange(len(cp)), offsets[:-1]))
        cp = cp[np.lexsort((rank, segment))]
    first = np.zeros(len(cp) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    while len(cp) > 1:
        i = np.flatnonzero(t.composes[cp[1:]] & ~first[1:]) + 1
        if not len(i):
            break
        a, b = cp[i - 1].astype(np.int64), cp[i].astype(np.int64)
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        k = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        joined = np.where(t.pair[k] == key, t.whole[k], 0).astype(np.int64)
        lv = (a >= _L0) & (a < _L0 + 19) & (b >= _V0) & (b < _V0 + 21)
        joined = np.where(lv, _S0 + ((a - _L0) * 21 + (b - _V0)) * 28, joined)
        lvt = (a >= _S0) & (a < _S0 + 11172) & ((a - _S0) % 28 == 0) & (b > _T0) & (b < _T0 + 28)
        joined = np.where(lvt, a + (b - _T0), joined)
        ok = joined > 0
        ok[1:] &= ~(ok[:-1] & (i[1:] == i[:-1] + 1))  # of two neighbours only the left one joins in this round
        if not ok.any():
            break
        cp[i[ok] - 1] = joined[ok].astype(np.uint32)
        gone = np.zeros(len(cp), bool)
        gone[i[ok]] = True
        first = first[~gone]
        cp, offsets = _drop(cp, offsets, gone)
    return cp, offsets


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array one after another, and where each row begins and ends."""
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    at = np.frombuffer(places, kind, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, at
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cp, starts[at]


def to_strings(cp: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The inverse of `code_points`."""
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[offsets]
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [valid, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def fold_code_points(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets in the one form; rows without a sign to change are only copied."""
    t = _tables()
    hits = np.flatnonzero(t.changes[cp])
    if not len(hits):
        return cp, offsets
    touched = np.zeros(len(offsets) - 1, bool)
    touched[np.searchsorted(offsets, hits, side="right") - 1] = True
    length = np.diff(offsets)
    inside = np.repeat(touched, length)
    part, ends = _fold_all(cp[inside], np.concatenate([[0], np.cumsum(length[touched])]), t)
    length[touched] = np.diff(ends)
    out = np.empty(length.sum(), np.uint32)
    inside_out = np.repeat(touched, length)
    out[inside_out], out[~inside_out] = part, cp[~inside]
    return out, np.concatenate([[0], np.cumsum(length)])


def _fold_all(cp: np.ndarray, offsets: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    size = t.size[cp].astype(np.int64)
    at = t.at[cp].astype(np.int64)
    # A joiner stays where it can be seen, a carriage return goes before a line feed.
    j = np.flatnonzero((cp == _ZWJ) | (cp == _ZWNJ))
    if len(j):
        inside = (j > 0) & (j + 1 < len(cp))
        seen = inside & t.joins[cp[np.maximum(j - 1, 0)]] & t.joins[cp[np.minimum(j + 1, len(cp) - 1)]]
        size[j[seen]], at[j[seen]] = 1, cp[j[seen]]
    tags = np.flatnonzero((cp >= _TAGS[0]) & (cp <= _TAGS[1]))
    if len(tags):
        begins = np.concatenate([[True], np.diff(tags) > 1])
        before = tags[begins] - 1
        of_flag = ((before >= 0) & (cp[np.maximum(before, 0)] == _FLAG))[np.cumsum(begins) - 1]
        size[tags[of_flag]], at[tags[of_flag]] = 1, cp[tags[of_flag]]
    r = np.flatnonzero(cp[:-1] == _CR)
    size[r[cp[r + 1] == _LF]] = 0
    ends = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(at - ends[:-1], size) + np.arange(ends[-1])
    return _compose(t.pool[source], ends[offsets], t)


def fold_array(texts: pa.Array) -> pa.Array:
    """A string array in the one form; null stays null."""
    cp, offsets = fold_code_points(*code_points(texts))
    return to_strings(cp, offsets, np.asarray(texts.is_null()) if texts.null_count else None)


def fold_text(text: str) -> str:
    """One text in the one form (for small dimension tables and tests)."""
    return fold_array(pa.array([text], pa.string()))[0].as_py()


def fold_column(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the folded form of column `text` in `out`, all other columns kept as they are.

    Null gives null and empty text gives empty text. A column that is already called `out` is
    replaced.
    """
    names = [c for c in df.columns if c != out]
    kept = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = fold_array(b.column(len(names))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], folded], names=b.schema.names)

    return kept.mapInArrow(run, kept.schema)


_PART = 1024


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id and the digests of each document's text (raw) and of its one form (form), once."""
    raw = docs.select(F.col(f"`{doc_id}`").alias("id"), F.md5(F.col(f"`{text}`").cast("binary")).alias("raw"), F.col(f"`{text}`").alias("body")).where("id is not null and body is not null")
    return staged(fold_column(raw, "body", "form").select("id", "raw", F.md5(F.col("form").cast("binary")).alias("form")), "lookalike").distinct()


def lookalike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its class of texts that look the same.

    Result: doc_id, class_id (the smallest id of the class), members (documents of the class), texts
    (different texts among them) and links (documents of the class whose text differs in code points).
    Null texts and null ids are left out, repeated rows count once; an empty table gives an empty
    result. Copies are counted before classes are, so a text with a third of all rows is one row.
    """
    keyed = _keyed(docs, doc_id, text)
    texts = keyed.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = texts.groupBy("form").agg(F.min("least").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("texts"))
    counted = texts.select("form", "raw", "n").join(classes, "form")
    return keyed.join(counted, ["form", "raw"]).select(F.col("id").alias(doc_id), "class_id", "members", "texts", (F.col("members") - F.col("n")).alias("links"))


def lookalike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents whose texts look the same but differ in code points.

    Result: doc_id_a < doc_id_b, once each. Equal texts make no pair, null texts and null ids are
    left out, repeated rows count once; two empty texts are equal. An empty table gives an empty
    result. Classes that hold only copies of one text are dropped before rows are paired. The pairs of a
    large class are as many as its definition asks for, but no task makes them all: its documents are
    dealt over parts, each of which meets the class by itself.
    """
    keyed = _keyed(docs, doc_id, text)
    texts = keyed.groupBy("form", "raw").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("form").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where("texts > 1").select("form", F.ceil(F.col("n") / _PART).cast("int").alias("parts"))
    few = staged(keyed.join(mixed, "form"), "alike")
    a = few.select("form", F.col("id").alias("doc_id_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = few.select("form", F.col("id").alias("doc_id_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["form", "part"]).where("doc_id_a < doc_id_b and raw_a <> raw_b").select("doc_id_a", "doc_id_b").distinct()
