"""Path functions as Columns, and glob patterns as regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forward(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last `.ext` of the base name with its dot; empty for dot-files and names without one."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


# The kinds of file whose hits count less, first match first, and how much they count.
README, MARKDOWN, TESTS, SETTINGS = 0.5, 0.7, 0.85, 0.8
_TEST_FILE = r"\.(test|spec)\.[^.]+$"
_TEST_FOLDER = "__(tests|test)__"
_SETTINGS_FILE = r"\.(json|ya?ml|toml|ini|cfg|conf)$"


def file_type_multiplier(path: Column) -> Column:
    """How much a hit in this kind of file counts: readme 0.5, other Markdown 0.7, tests 0.85, configuration and dot-files 0.8, else 1."""
    low = F.lower(path)
    base = base_name(low)
    return (
        F.when(base == "readme.md", README)
        .when(low.endswith(".md"), MARKDOWN)
        .when(low.rlike(_TEST_FILE) | low.rlike(_TEST_FOLDER) | low.contains("/test/"), TESTS)
        .when(low.rlike(_SETTINGS_FILE) | base.startswith("."), SETTINGS)
        .otherwise(1.0)
    )


def ancestors(home: Column) -> Column:
    """`/` and every folder on the way to `home`, itself included."""
    parts = F.filter(F.split(home, "/"), lambda p: p != "")
    below = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("/")), below)


def resolve_from(root: Column, path: Column) -> Column:
    """An absolute path stays; a relative one is put under `root`."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(path, r"^(\./)+", "")))


def expand_home(path: Column, home: Column) -> Column:
    return F.when(path.startswith("~/"), F.concat(home, F.substring(path, 2, 1_000_000))).otherwise(path)


def relative_to(root: Column, path: Column) -> Column:
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: `*` and `?` stay within a folder and skip leading dots, `**` crosses folders but no dot-folder, `{a,b}` and `[..]` as usual."""
    out, i, depth, start = "", 0, 0, True
    no_dot = r"(?!\.)"
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and start:
            out += rf"(?:{no_dot}[^/]+/)*"
            i += 3
            continue
        if pattern.startswith("**", i) and start and i + 2 == len(pattern):
            out += rf"(?:{no_dot}[^/]+(?:/{no_dot}[^/]+)*)?"
            break
        if c == "*":
            out += (no_dot if start else "") + "[^/]*"
            i += 1
            while pattern[i : i + 1] == "*":
                i += 1
            start = False
            continue
        if c == "?":
            out += (no_dot if start else "") + "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]"
            i = end
        else:
            out += "\\" + c if c in r"\.+^$()|[]{}" else c
        start = c == "/" or (start and c in "{,") or (c == "," and depth > 0)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs; false without globs."""
    if not patterns:
        return F.lit(False)
    return forward(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def like_prefix(path: Column, prefix: str | None) -> Column | None:
    """Paths that begin with the prefix, in any letter case; `%` and `_` in it are wildcards; no filter if empty."""
    return path.ilike(prefix.replace("\\", "\\\\") + "%") if prefix else None
