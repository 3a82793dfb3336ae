"""Which files are indexed, which folders are barred, and which searches are better asked of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.paths import ancestors, matches_any


def should_index(path: Column, size_bytes: Column, include: list[str], exclude: list[str], ignored: list[str], max_file_size_kb: int) -> Column:
    """Included, neither excluded nor ignored, and of a known size within the limit."""
    return F.coalesce(matches_any(path, include) & ~matches_any(path, exclude) & ~matches_any(path, ignored) & (size_bytes <= max_file_size_kb * 1024), F.lit(False))


def is_whitelisted(path: Column, whitelist: list[str]) -> Column:
    """The path is an entry or lies under one."""
    out = F.lit(False)
    for w in whitelist:
        out = out | (path == w) | path.startswith(w.rstrip("/") + "/")
    return out


def is_blacklisted(path: Column, blacklist: list[str], whitelist: list[str], home: Column) -> Column:
    """The path is an entry, `/`, or a folder on the way to `home`; a whitelisted one never is."""
    barred = F.array_union(ancestors(home), F.array(*map(F.lit, blacklist)).cast("array<string>"))
    return ~is_whitelisted(path, whitelist) & F.array_contains(barred, path)


def whitelisted_paths(paths: DataFrame, whitelist: DataFrame, path: str = "path", entry: str = "entry") -> DataFrame:
    """The same for a list kept as a table: an equi-join of every ancestor of a path with the entries, no theta join."""
    own = paths.select(F.col(path)).distinct().withColumn("__up", F.explode(ancestors(F.col(path))))
    return own.join(whitelist.select(F.col(entry).alias("__up")).distinct(), "__up", "left_semi").select(path).distinct()


# What makes a text search no question for the index.
_EXPRESSION = r"[*+?\[\]{}()|\\^$]"
_FILE = r"(?i)\.[a-z0-9]+$"
_MEMBER = r"\w\.\w"
_SLASH = r"[/\\]"
_QUOTED = "^[\"']|[\"']$"
_MARKER = "^[@#]|TODO|FIXME|HACK|XXX|DEPRECATED"
_ADDRESS = "://|localhost"


def redirects_grep(pattern: Column, path: Column, output_mode: Column, min_length: int = 4) -> Column:
    """Whether a text search reads like a question for the index: long enough, no expression, no file, no literal."""
    p, f, mode = F.coalesce(pattern, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(output_mode, F.lit("files_with_matches"))
    rejects = (
        (F.length(p) < min_length)
        | F.regexp_replace(p, r"\\\.", "").rlike(_EXPRESSION)
        | ((f != "") & ~f.endswith("/") & f.rlike(_FILE))
        | mode.isin("count", "content")
        | p.rlike(_MEMBER)
        | p.rlike(_SLASH)
        | p.rlike(_QUOTED)
        | p.rlike(_MARKER)
        | p.rlike(_ADDRESS)
    )
    return ~rejects
