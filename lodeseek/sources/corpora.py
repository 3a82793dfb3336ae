"""Corpora from tables, folders and repositories."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.session import file_system, spread, staged_path

# Folders that no listing enters. All dot folders are skipped besides.
SKIPPED = "node_modules venv __pycache__ dist build .DS_Store".split()

_INGESTED: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fingerprint(spark: SparkSession, path: str) -> str:
    """A text that changes when the files below `path` do: their number, size and latest time."""
    fs, root = file_system(spark, path)
    s = fs.getContentSummary(root)
    return f"{path} {s.getFileCount()} {s.getLength()} {max((f.getModificationTime() for f in fs.listStatus(root)), default=0)}"


def kept(spark: SparkSession, key: str, what: str, make: Callable[[], DataFrame]) -> str:
    """Where the table that `make` gives is stored: staged on first use in this session, as long as `key` stays the same."""
    at = (spark.sparkContext.applicationId, f"{what} {key}")
    if at in _INGESTED:
        fs, path = file_system(spark, _INGESTED[at])
        if fs.exists(path):
            return _INGESTED[at]
    _INGESTED[at] = staged_path(make(), what)
    return _INGESTED[at]


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The chunk table as the index holds it, rows delivered twice taken once.

    That is done at ingestion, once for each state of the table in a session, so a query reads its
    columns and pushes its filters down without a shuffle of its own.
    """
    raw = table(spark, folder, "chunks")
    path = kept(spark, fingerprint(spark, f"{folder}/chunks.parquet"), "chunks", lambda: raw.repartition(spread(spark), "id").dropDuplicates(["id"]))
    stored = spark.read.schema(raw.schema).parquet(path)
    return stored.select(*columns) if columns else stored


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file_path and content: documents as files; those without a path get one from their source."""
    source = F.regexp_replace(F.lower(F.trim("source")), "[- ]", "_")
    path = F.coalesce("file_path", F.concat(F.lit("notes/"), F.coalesce(source, F.lit("none")), F.lit("/d"), "doc_id", F.lit(".md")))
    return table(spark, folder, "documents").select("doc_id", path.alias("file_path"), F.col("text").alias("content"))


def folder_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file_path (below `root`), size_bytes, modified_at and the full path of every file under a folder, without skipped and dot folders; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    names = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    barred = rf"(^|/)({names})(/|$)|(^|/)\.[^/]+/"
    return raw.select(below.alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "path", "content").where(~F.col("file_path").rlike(barred))


def folder_files(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """file_path (below `root`), size_bytes, content, content_hash and modified_at of every file under a folder, without skipped and dot folders. Files above `max_bytes` are left out before they are opened."""
    found = folder_listing(spark, root, pattern)
    if max_bytes is not None:
        found = found.where(F.col("size_bytes") <= max_bytes)
    return found.select("file_path", "size_bytes", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), "modified_at")


def modified_since(files: DataFrame, at: str | None) -> DataFrame:
    """Files whose time is after `at`; all of them without one."""
    return files if at is None else files.where(F.col("modified_at") > F.to_timestamp(F.lit(at)))


def _git(root: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, check=True, text=True, encoding="utf-8").stdout  # noqa: S603, S607
    return [line for line in out.split("\n") if line.strip()]


def is_repository(root: str) -> bool:
    try:
        return bool(_git(root, "rev-parse", "--git-dir"))
    except (OSError, subprocess.CalledProcessError):
        return False


def _paths(spark: SparkSession, *lists: list[str]) -> DataFrame:
    rows = [(k, p) for k, p in enumerate(dict.fromkeys(p for x in lists for p in x))]
    return spark.createDataFrame(rows, "place bigint, file_path string")


def repository_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """place and file_path of a repository's files: tracked ones, then those neither tracked nor ignored, each once, cut to the first `max_files`; outside a repository the folder's listing, by path.

    A local repository's listing is what its version control prints; a corpus that is too large for
    that is a table to begin with.
    """
    if is_repository(root):
        found = _paths(spark, _git(root, "ls-files"), _git(root, "ls-files", "--others", "--exclude-standard"))
    else:
        from pyspark.sql import Window

        found = folder_listing(spark, root).select("file_path").withColumn("place", F.row_number().over(Window.orderBy("file_path")) - 1).select(F.col("place").cast("bigint"), "file_path")
    return found if max_files is None else found.orderBy("place").limit(max_files)


def repository_changes(spark: SparkSession, root: str, since: str) -> DataFrame:
    """place and file_path of what changed since an ISO time: committed since, different from the last commit, or untracked; the whole listing outside a repository; nothing if version control fails."""
    if not is_repository(root):
        return repository_files(spark, root)
    try:
        return _paths(spark, _git(root, "log", f"--since={since}", "--name-only", "--pretty=format:"), _git(root, "diff", "--name-only", "HEAD"), _git(root, "ls-files", "--others", "--exclude-standard"))
    except (OSError, subprocess.CalledProcessError):
        return _paths(spark)


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Globs of an ignore file: trimmed lines without blank ones and comments; none if the file is missing. A file of a few lines, read whole."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path).select(F.trim("value").alias("v"))
        return [r.v for r in lines.where("v <> '' and not startswith(v, '#')").collect()]
    except AnalysisException:
        return []
