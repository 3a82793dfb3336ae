"""Files that nobody wrote by hand: generated, minified, vendored, or data kept as code (problem 2).

Each chunk gives layout statistics (line lengths, whitespace and letter shares, numeric literals,
encoded runs) computed on whole Arrow batches, and whether a comment in it declares the file as
generated or taken over. Chunk figures add up to file figures in one map-side aggregation. A file is
found by statistics beyond its language's limits: maximum and mean line, blanks, letters and digits,
numeric literals, encoded runs. Copied and generated files whose layout is that of ordinary code are
found by their path or by what they declare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.lookalike import code_points

# Folders and names that tools and package managers use.
VENDOR_DIRS = "vendor vendors vendored third_party third-party thirdparty 3rdparty external node_modules bower_components jspm_packages site-packages pods carthage".split()
GENERATED_DIRS = "__generated__ _generated generated gen autogen auto_generated".split()
GENERATED_NAMES = r"(\.generated\.\w+|[._-]gen\.\w+|_generated\.\w+|\.g\.\w+|\.pb\.\w+(\.\w+)?|_pb2(_grpc)?\.pyi?|_pb\.(js|d\.ts|rb)|\.designer\.\w+|\.freezed\.dart|\.pb-c\.[ch]|_string\.go|\.snap)$"
LOCK_NAMES = r"(^|/)([^/]*[-.]lock\.(json|ya?ml)|[^/]*\.lock|[^/]*\.lockb?|npm-shrinkwrap\.json|go\.sum|package\.resolved|[^/]*\.lock\.hcl)$"
MINIFIED_NAMES = r"([.-]min\.(js|mjs|cjs|css|html)|\.bundle\.(js|css)|\.chunk\.(js|css)|[.-][0-9a-f]{8,20}\.(js|mjs|css)|\.(js|css)\.map)$"

# How tools and people declare that a file is not written by hand. Each stands at the start of a comment.
_DECLARED = (
    ("generated", r"code generated (?:by|from|with)\b.*|.{0,40}\bautomatically[- ](?:generated|created|written|produced|built)\b.*|@generated\b.*|<auto-?generated\b.*|auto-?generated (?:file|code|by|from|with)\b.*|(?:this (?:file|code|module|source) (?:is|was|has been) )(?:generated|produced|created|written|emitted) (?:by|from|with|automatically)\b.*|(?:generated|produced|created|emitted|compiled|built) (?:by|from|with) (?:the )?[\w.@/-]*(?:gen|bindgen|compiler|protoc|tool|generator|c|script|build|openapi|swagger|graphql|thrift|antlr|bison|flex|yacc|lex|swig)\b.*|do not edit(?:[.!:;]|$| (?:this file|by hand|manually)).*|.{0,30}\bautomatisch (?:erzeugt|generiert|erstellt)\b.*|.{0,30}\b(?:généré|generado|generato|gerado) (?:automatiquement|automáticamente|automaticamente)\b.*|.{0,30}自動生成.*|.{0,30}сгенерирован.{0,6} автоматически.*"),
    ("vendored", r"vendored (?:from|copy|by)\b.*|bundled copy of\b.*|(?:imported|taken over|copied|adapted) (?:unchanged |verbatim )?from upstream\b.*|third[- ]party (?:code|library|source)\b.*|.{0,20}\bcopyright \(c\) .{0,80}(?:third[- ]party|imported at|upstream|\bauthors\b|\bcontributors\b).*|[\w.-]+ v?\d+(?:\.\d+)+ \| \(c\) .*|.{0,80}\| (?:mit|bsd|apache|isc|mpl|gpl)[\w .-]{0,12}licen[cs]e.*|.{0,60}released under the (?:mit|bsd|apache|isc)\b.*"),
)
_COMMENT = r"^[ \t]*(?://+|#+|--+|/\*+!?|\*+|<!--|;+|%+|'|\"\"\"|rem )[ \t!*]*"
DECLARED = tuple((kind, re.compile(f"(?im){_COMMENT}(?:{rule})$")) for kind, rule in _DECLARED)
_HINTS = ("generated", "do not edit", "automati", "autogen", "auto-gen", "produced", "created", "written by", "emitted", "compiled", "built ", "vendored", "bundled", "upstream", "third", "(c)", "license", "licence", "released under", "généré", "generado", "generato", "gerado", "自動生成", "сгенерирован")

class Limits(NamedTuple):
    """What hand-written code of a language keeps to."""

    longest: int  # lines from this length on are looked at as dense
    mean: int  # as are all long lines of a text whose mean line reaches this (minified code that was wrapped)
    blank: float  # a dense line or text has less than this share of blanks
    alnum: float  # and a dense text at most this share of letters and digits: it is neither prose nor data
    digits: float  # share of numeric literals from which a text is data


# Tuned by language on the layout of hand-written code: blanks stay at about half the language's usual share (13 % for most,
# 15 % where braces are set apart), mean lines at twice its usual mean line, numeric literals at about twice the densest hand-made table.
_BRACES, _INDENT, _COLUMNS, _KEYS = Limits(300, 80, 0.09, 0.85, 0.35), Limits(500, 90, 0.06, 0.85, 0.35), Limits(500, 140, 0.06, 0.88, 0.4), Limits(500, 80, 0.06, 0.88, 0.4)
LIMITS = {
    **dict.fromkeys("js mjs cjs jsx ts tsx css html vue svelte php".split(), _BRACES),
    **dict.fromkeys("go rs java kt c h cc cpp hpp cs swift scala dart".split(), Limits(500, 90, 0.06, 0.85, 0.35)),
    **dict.fromkeys("py rb sh bash pl lua r jl".split(), _INDENT),
    **dict.fromkeys("sql".split(), _COLUMNS),
    **dict.fromkeys("json yml yaml toml ini env cfg xml".split(), _KEYS),
}
OTHER = Limits(500, 80, 0.06, 0.85, 0.4)
PROSE = "md rst txt adoc org".split()
# A dense line is code only if this share of it is punctuation; text in a script without blanks is not dense.
SIGN_SHARE = 0.12
# A chunk or file counts where dense lines or data reach both figures, or data all but fill it.
DENSE_SHARE, DENSE_CHARS = 0.5, 500
DATA_SHARE, DATA_CHARS = 0.5, 1000
DATA_ALL_SHARE, DATA_ALL_CHARS, DATA_ALL_FILE_CHARS = 0.85, 600, 250

_STATS = ("chars", "lines", "max_line", "blanks", "alnum", "digits", "dense", "data")
STATS_SCHEMA = "path string, digest string, " + ", ".join(f"{c} bigint" for c in _STATS) + ", numeric boolean, generated boolean, vendored boolean"


def limits_of(paths: list[str | None]) -> np.ndarray:
    """The limits for each path's language, a row each."""
    return np.array([LIMITS.get((p or "").rsplit("/", 1)[-1].rpartition(".")[2].lower(), OTHER) for p in paths], float).reshape(len(paths), len(Limits._fields))


def _classes() -> np.ndarray:
    """Bit sets of ASCII signs: 1 blank, 2 letter or digit, 4 digit, 8 letter that no number has, 16 base64, 32 upper, 64 lower, 128 quote or comma."""
    t = np.zeros(256, np.uint8)
    for c in map(chr, range(128)):
        k = ord(c)
        t[k] = 1 * c.isspace() + 2 * c.isalnum() + 4 * c.isdigit() + 8 * (c.isalpha() and c not in "abcdefABCDEFxX") + 16 * (c.isalnum() or c in "+/=_-") + 32 * c.isupper() + 64 * c.islower() + 128 * (c in "\"'`,;+\\[](){}")
    t[128:] = 2 + 8  # any other sign stands for a letter
    return t


_CLASS = _classes()
_SIGN = np.array([chr(k) in "(){}[];=,.:&|!<>?+-*/%^~" for k in range(256)], np.int32)


def layout(texts: pa.Array, limits: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Layout statistics of each text, with the limits of each text's language.

    `dense` counts the characters of lines that are long and tight for the language, `data` those of
    lines that are only numeric literals or one encoded literal, outside PEM blocks; `numeric` says
    whether the text's share of digits is beyond the language's limit.
    """
    cp, ends = code_points(texts)
    n = len(ends) - 1
    out = {k: np.zeros(n, np.int64) for k in (*_STATS, "numeric")}
    if limits is None:
        limits = limits_of([None] * n)
    longest, mean, least_blank, most_alnum, most_digits = limits.T
    if not len(cp):
        return out
    kind = _CLASS[np.minimum(cp, 255)]
    starts = np.zeros(len(cp), bool)
    starts[1:] = cp[:-1] == 10
    starts[ends[:-1][np.diff(ends) > 0]] = True
    first = np.flatnonzero(starts)
    row = np.searchsorted(ends, first, side="right") - 1
    length = np.diff(np.append(first, len(cp)))
    length -= cp[first + length - 1] == 10

    def count(bit: int) -> np.ndarray:
        return np.add.reduceat(((kind & bit) > 0).astype(np.int32), first)

    blank, alnum, digit, wordy, b64, upper, lower, punct = (count(1 << i) for i in range(8))
    dash = np.add.reduceat((cp == 45).astype(np.int32), first)
    signs = np.add.reduceat(_SIGN[np.minimum(cp, 255)], first)
    foreign = np.add.reduceat((cp > 127).astype(np.int32), first)
    pem = (dash >= 10) & (cp[first] == 45)
    # Lines between an opening and a closing PEM marker of the same text.
    marks = np.cumsum(pem) - pem
    base = np.zeros(n + 1, np.int64)
    np.maximum.at(base[1:], row, marks + pem)
    base = np.maximum.accumulate(base)
    inside = ((marks - base[row]) % 2 == 1) & (length <= 80)
    numeric = (digit >= 8) & (wordy <= 2) & (digit * 10 >= length * 3) & (length > 20)
    # Short runs of letters in hexadecimal literals look like words of a-f only.
    encoded = (length - punct - blank <= b64) & (b64 >= 40) & (blank <= 8) & (upper > 4) & (lower > 4) & (digit > 1)
    data = (numeric | encoded) & ~pem & ~inside
    code = (signs >= SIGN_SHARE * length) & (foreign <= 0.1 * length)
    total = np.diff(ends)
    of = lambda v: np.bincount(row, v, minlength=n)
    tight = of(blank) < least_blank * total
    wrapped = (total >= mean * np.bincount(row, minlength=n)) & (of(alnum) <= most_alnum * total) & tight
    long = (length >= longest[row]) | (wrapped[row] & (length >= mean[row]) & ~data)
    dense = long & (blank < least_blank[row] * length) & code
    out["chars"], out["lines"] = total, np.bincount(row, minlength=n)
    np.maximum.at(out["max_line"], row, length)
    for k, v in (("blanks", blank), ("alnum", alnum), ("digits", digit), ("data", length * data), ("dense", length * dense)):
        out[k] = np.bincount(row, v, minlength=n).astype(np.int64)
    # Between PEM markers digits are part of a key or certificate.
    out["numeric"] = (total >= DATA_ALL_CHARS) & (of(digit * ~inside) >= most_digits * total)
    return out


def declares(text: str) -> tuple[bool, bool]:
    """Whether a comment declares the text as generated, and as taken over from elsewhere."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return False, False
    return bool(DECLARED[0][1].search(text)), bool(DECLARED[1][1].search(text))


def chunk_layout(chunks: DataFrame, path: str = "file_path", text: str = "chunk_text") -> DataFrame:
    """One row of statistics and declarations for each chunk; null texts count as empty, null paths are left out."""
    rows = chunks.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where("path is not null").select("path", F.md5(F.col("t").cast("binary")).alias("digest"), "t")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = layout(b.column(2), limits_of(b.column(0).to_pylist()))
            said = [declares(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), *(pa.array(s[k], pa.int64()) for k in _STATS), pa.array(s["numeric"].astype(bool)), pa.array([x for x, _ in said], pa.bool_()), pa.array([x for _, x in said], pa.bool_())],
                names=["path", "digest", *_STATS, "numeric", "generated", "vendored"],
            )

    return rows.mapInArrow(op, STATS_SCHEMA)


def path_kind(path: Column) -> Column:
    """`generated`, `lock`, `minified` or `vendored` where the path alone shows it, else null."""
    p = F.regexp_replace(path, r"\\", "/")
    low = F.lower(p)
    folder = lambda names: low.rlike(r"(^|/)(" + "|".join(n.replace(".", r"\.") for n in names) + ")/")
    return F.when(low.rlike(LOCK_NAMES), "lock").when(low.rlike(MINIFIED_NAMES), "minified").when(folder(VENDOR_DIRS), "vendored").when(low.rlike(GENERATED_NAMES) | folder(GENERATED_DIRS), "generated")


def file_layout(chunks: DataFrame, path: str = "file_path", text: str = "chunk_text") -> DataFrame:
    """One row for each file: the sums of its different chunks' statistics and whether one of them reaches a limit by itself. Equal chunks of a file count once."""
    prose = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(PROSE)
    stats = [F.first(c).alias(c) for c in (*_STATS, "numeric", "generated", "vendored")]
    per = chunk_layout(chunks, path, text).groupBy("path", "digest").agg(*stats).withColumn("prose", prose)
    return per.groupBy("path", "prose").agg(
        *(F.sum(c).alias(c) for c in _STATS if c != "max_line"),
        F.max("max_line").alias("max_line"), F.max("generated").alias("generated"), F.max("vendored").alias("vendored"),
        F.max(_reached("dense", DENSE_CHARS, DENSE_SHARE)).alias("one_dense"), F.max(_holds_data(DATA_ALL_CHARS) | (~F.col("prose") & F.col("numeric"))).alias("one_data"),
    )


def _reached(x: str, least: int, share: float) -> Column:
    return ~F.col("prose") & (F.col(x) >= least) & (F.col(x) >= share * F.col("chars"))


def _holds_data(all_chars: int) -> Column:
    return _reached("data", DATA_CHARS, DATA_SHARE) | _reached("data", all_chars, DATA_ALL_SHARE)


def not_hand_written(chunks: DataFrame, path: str = "file_path", text: str = "chunk_text", by_layout_alone: bool = False) -> DataFrame:
    """The files of `chunks` that nobody wrote by hand, each once, with the reason.

    Result: file_path, reason, and the file's chars, lines, max_line, mean_line, blank_share,
    alnum_share, digit_share, dense_share and data_share. Layout speaks first: minified or data. What
    reads like ordinary code can be shown only by its path or by what a comment declares: lock,
    minified, vendored or generated; with `by_layout_alone` these are left out. A chunk that reaches a
    limit by itself is enough, as is the whole file. Repeated rows count once. Null paths are left out,
    null and empty texts have no layout, an empty table gives an empty result.
    """
    file = file_layout(chunks, path, text)
    shown = (
        F.when(F.col("one_dense") | _reached("dense", DENSE_CHARS, DENSE_SHARE), "minified").when(F.col("one_data") | _holds_data(DATA_ALL_FILE_CHARS), "data")
    )
    declared = F.coalesce(path_kind(F.col("path")), F.when(F.col("vendored") & ~F.col("prose"), "vendored").when(F.col("generated") & ~F.col("prose"), "generated"))
    reason = shown if by_layout_alone else F.coalesce(shown, declared)
    share = lambda x: F.round(F.col(x) / F.greatest(F.col("chars"), F.lit(1)), 4).alias
    return file.withColumn("reason", reason).where("reason is not null").select(
        F.col("path").alias("file_path"), "reason", "chars", "lines", "max_line", F.round(F.col("chars") / F.greatest(F.col("lines"), F.lit(1)), 2).alias("mean_line"), share("blanks")("blank_share"), share("alnum")("alnum_share"), share("digits")("digit_share"), share("dense")("dense_share"), share("data")("data_share")
    )
