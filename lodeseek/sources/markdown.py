"""Markdown files with front matter, the paths a project adds, and coverage reports."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = re.compile(r"\A---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\Z)(.*)\Z", re.DOTALL)
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
# Fixed value: the line of a coverage report that sums up all files.
_ALL_FILES = r"(?m)^All files\s+\|\s+(\d+(?:\.\d+)?)\s+\|\s+(\d+(?:\.\d+)?)\s+\|"
# Fixed value: the share of functions and of lines that must be covered.
COVERAGE_THRESHOLD = 90


def scalar(text: str) -> Any:
    """A front-matter value: true or false, a number, else text, without quotes around it."""
    t = text.strip()
    if t in ("true", "false"):
        return t == "true"
    if _NUMBER.fullmatch(t):
        x = float(t)
        return int(x) if x.is_integer() else x
    return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'" else t


def front_matter(text: str) -> dict[str, Any]:
    """Keys and values of front matter; a key without a value holds the keys that are indented below it. Lines without a colon say nothing."""
    root: dict[str, Any] = {}
    open_at: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for line in text.splitlines():
        key, colon, value = line.strip().partition(":")
        if not colon:
            continue
        depth = len(line) - len(line.lstrip())
        while len(open_at) > 1 and depth <= open_at[-1][0]:
            open_at.pop()
        if value.strip():
            open_at[-1][1][key.strip()] = scalar(value)
        else:
            below: dict[str, Any] = {}
            open_at[-1][1][key.strip()] = below
            open_at.append((depth, below))
    return root


def entry(content: str, key: str) -> dict[str, Any]:
    """The front matter of a Markdown text, with the trimmed body under `key`; a body of blanks is left out."""
    text = content.replace("\r\n", "\n")
    m = _PARTS.match(text)
    head, body = (m[1], m[2]) if m else ("", text)
    return front_matter(head) | ({key: body.strip()} if body.strip() else {})


def folder_entries(spark: SparkSession, root: str, key: str) -> dict[str, dict[str, Any]]:
    """The entries of the `.md` files right in a folder, by name without its ending; empty ones are left out. A folder of a few templates."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(root).select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), F.decode("content", "UTF-8").alias("t")).orderBy("name").collect()
    except AnalysisException:
        return {}
    return {r.name: found for r in rows if (found := entry(r.t, key))}


def with_bundled(config: dict[str, Any], agents: dict[str, Any], commands: dict[str, Any], skill_paths: list[str]) -> dict[str, Any]:
    """A host's settings with bundled agents and commands under its own ones, and bundled skill paths after its own, each once."""
    own = lambda k: config.get(k) if isinstance(config.get(k), dict) else {}
    out = dict(config)
    if agents:
        out["agent"] = agents | own("agent")
    if commands:
        out["command"] = commands | own("command")
    if skill_paths:
        have = own("skills").get("paths")
        out["skills"] = own("skills") | {"paths": list(dict.fromkeys([*(have if isinstance(have, list) else []), *skill_paths]))}
    return out


def coverage(reports: DataFrame, text: str = "text", threshold: float = COVERAGE_THRESHOLD) -> DataFrame:
    """`reports` with functions and lines (percent, null without the line for all files) and whether both reach the threshold."""
    part = lambda k: F.regexp_extract(F.col(text), _ALL_FILES, k).try_cast("double")
    out = reports.withColumns({"functions": part(1), "lines": part(2)})
    return out.withColumn("enough", (F.col("functions") >= threshold) & (F.col("lines") >= threshold))
