"""Cutting files into chunks: at syntax boundaries, or by size with overlapping lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.paths import extension

# What a line begins with where a chunk begins, by extension.
_TS = r"^(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const\s+\w+\s*=\s*(?:async\s+)?\(|enum)\b"
_JS = r"^(?:export\s+)?(?:async\s+)?(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?\()\b"
BOUNDARIES = {
    ".ts": _TS,
    ".tsx": _TS,
    ".js": _JS,
    ".jsx": _JS,
    ".py": "^(?:def |class |async def )",
    ".go": "^(?:func |type )",
    ".rs": r"^(?:pub\s+)?(?:fn |struct |enum |impl |trait |mod )",
    ".java": r"^(?:public |private |protected )?(?:static\s+)?(?:class |interface |enum |.*\s+\w+\s*\()",
    ".rb": "^(?:def |class |module )",
    ".php": "^(?:function |class |interface |trait )",
    ".sql": "(?i)^(?:CREATE |ALTER |DROP |INSERT |SELECT |WITH |-- ===)",
}
CHARS_PER_TOKEN = 4
# Java before 19 counts letters of all scripts as word signs at \\b, the fixed patterns mean ASCII alone: `classé` begins a class there.
_ASCII_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SPANS = "array<struct<chunk_index:int,start_line:int,end_line:int>>"


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def _line_number_if(pattern: str):  # noqa: ANN202
    return lambda x, i: F.when(x.rlike(pattern), i + 1)


def _boundary_lines(lines: Column, ext: Column) -> Column:
    """Numbers of the lines that begin a chunk. Only the branch of the file's own extension is evaluated, once over its lines."""
    out = None
    for e, pattern in BOUNDARIES.items():
        at = F.filter(F.transform(lines, _line_number_if(pattern.replace(r"\b", _ASCII_EDGE))), lambda n: n.isNotNull())
        out = F.when(ext == e, at) if out is None else out.when(ext == e, at)
    return F.coalesce(out, F.array().cast("array<int>"))


def syntax_spans(content: Column, path: Column, keep_preamble: bool = False) -> Column:
    """Spans from each boundary line to the line before the next; empty with fewer than two boundaries.

    Lines before the first boundary belong to no span, unless `keep_preamble` adds them as one.
    """
    lines = lines_of(content)
    at = _boundary_lines(lines, extension(path))
    starts = F.when(F.get(at, F.lit(0)) > 1, F.concat(F.array(F.lit(1)), at)).otherwise(at) if keep_preamble else at
    following = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines) + 1))
    pairs = F.zip_with(starts, following, lambda a, z: F.struct(a.alias("a"), z.alias("z")))
    spans = F.transform(pairs, lambda x, k: F.struct(k.alias("chunk_index"), x["a"].alias("start_line"), (x["z"] - 1).alias("end_line")))
    return F.when(F.size(at) >= 2, spans).otherwise(F.array().cast(_SPANS))


def spans_by_size(lengths: list[int], max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """(index, first, last) of each chunk over lines of these lengths.

    A chunk ends with the line that brings it (each line with its feed) to `max_chars`. The next one
    starts with as many trailing lines as reach `overlap_chars`, none for 0. What is left at the end is
    a chunk too, even if it is only overlap.
    """
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n + 1)
    out, first, line, total = [], 1, 1, len(lengths)
    while line <= total:
        if ends[line] - ends[first - 1] < max_chars:
            line += 1
            continue
        out.append((len(out), first, line))
        back = line + 1
        while back > first and ends[line] - ends[back - 1] < overlap_chars:
            back -= 1
        first, line = back, line + 1
    if first <= total:
        out.append((len(out), first, total))
    return out


def fixed_spans(content: Column, max_tokens: int = 512, overlap_tokens: int = 50) -> Column:
    """Spans of whole lines of about `max_tokens` with about `overlap_tokens` in common. Only line lengths go to Python."""
    size, overlap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN

    @F.pandas_udf(_SPANS)
    def fold(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: None if x is None else [dict(zip(("chunk_index", "start_line", "end_line"), s, strict=True)) for s in spans_by_size(list(x), size, overlap)])

    return fold(F.transform(lines_of(content), lambda x: F.length(x)))


def chunk_files(files: DataFrame, path: str = "file_path", content: str = "content", strategy: str = "hybrid", max_tokens: int = 512, overlap_tokens: int = 50, keep_preamble: bool = False) -> DataFrame:
    """All columns of `files` but the content, with chunk_index, chunk_text, start_line and end_line.

    `syntax` and `hybrid` cut at syntax boundaries where there are two or more and by size elsewhere;
    `fixed` always cuts by size. A null content gives no chunk, an empty one an empty chunk.
    """
    text, name = F.col(f"`{content}`"), F.col(f"`{path}`")
    if strategy not in ("syntax", "hybrid", "fixed"):
        raise ValueError(f"no such strategy: {strategy}")
    kept = [c for c in files.columns if c not in (content, "chunk_index", "chunk_text", "start_line", "end_line")]
    rows = files.where(text.isNotNull()).withColumn("__lines", lines_of(text))
    if strategy == "fixed":
        rows = rows.withColumn("__spans", fixed_spans(text, max_tokens, overlap_tokens))
    else:
        rows = rows.withColumn("__syntax", syntax_spans(text, name, keep_preamble))
        # Files with boundaries don't go through Python.
        cut = rows.where(F.size("__syntax") > 0).withColumn("__spans", F.col("__syntax"))
        rows = cut.unionByName(rows.where(F.size("__syntax") == 0).withColumn("__spans", fixed_spans(text, max_tokens, overlap_tokens)))
    out = rows.select(*[F.col(f"`{c}`") for c in kept], "__lines", F.explode("__spans").alias("__s"))
    body = F.array_join(F.slice("__lines", F.col("__s.start_line"), F.col("__s.end_line") - F.col("__s.start_line") + 1), "\n")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__s.chunk_index").alias("chunk_index"), body.alias("chunk_text"), F.col("__s.start_line").alias("start_line"), F.col("__s.end_line").alias("end_line"))


def register_chunk_udtf(spark) -> None:  # noqa: ANN001
    """`chunk_text(content[, max_tokens, overlap_tokens])` for SQL: lateral rows of chunk_index, start_line, end_line, text, cut by size."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, start_line int, end_line int, text string", useArrow=True)
    class ChunkText:
        def eval(self, content: str, max_tokens: int = 512, overlap_tokens: int = 50):  # noqa: ANN202
            if content is not None:
                lines = content.split("\n")
                for k, a, b in spans_by_size([len(x) for x in lines], max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN):
                    yield k, a, b, "\n".join(lines[a - 1 : b])

    spark.udtf.register("chunk_text", ChunkText)
