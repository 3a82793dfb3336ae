"""What is in the index: counts, coverage, sync state, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.paths import extension
from lodeseek.functions.scoring import half_up

PROGRESS_KEYS = ("sync_status", "sync_started_at", "sync_total_files", "sync_completed_files", "sync_current_file", "sync_error")


def index_stats(chunks: DataFrame) -> DataFrame:
    """files, chunks, avg_chunks_per_file (one decimal) in one row."""
    s = chunks.agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks"))
    return s.withColumn("avg_chunks_per_file", F.when(F.col("files") > 0, half_up(F.col("chunks") / F.col("files"), 1)).otherwise(0.0))


def file_stats(chunks: DataFrame) -> DataFrame:
    """file_path, chunks, last_updated, latest first."""
    return chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.max("updated_at").alias("last_updated")).orderBy(F.desc_nulls_last("last_updated"), "file_path")


def extension_counts(chunks: DataFrame) -> DataFrame:
    """Indexed files by extension, most frequent first."""
    ext = extension(F.col("file_path"))
    files = chunks.groupBy("file_path").agg(F.lit(1).alias("one"))
    return files.groupBy(F.when(ext == "", "(none)").otherwise(ext).alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension")


def coverage(chunks: DataFrame, files: DataFrame, eligible: Column) -> DataFrame:
    """files, eligible and coverage_percent (whole; null without eligible files)."""
    have = chunks.agg(F.count_distinct("file_path").alias("files"))
    could = files.where(eligible).agg(F.count_distinct("file_path").alias("eligible"))
    return have.crossJoin(could).withColumn("coverage_percent", F.when(F.col("eligible") > 0, half_up(F.col("files") / F.col("eligible") * 100)))


def sync_progress(state: DataFrame) -> DataFrame:
    """The sync entries of the state table as one map."""
    rows = state.where(F.col("key").like("sync_%"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("progress"))


def state_value(state: DataFrame, key: str) -> str | None:
    row = state.where(F.col("key") == key).select("value").first()
    return row[0] if row else None


def set_state(state: DataFrame, key: str, value: str) -> DataFrame:
    """The state table with one entry put or replaced."""
    fresh = state.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return state.where(F.col("key") != key).select("key", "value").unionByName(fresh)


def clear_progress(state: DataFrame) -> DataFrame:
    return state.where(~F.col("key").isin(*PROGRESS_KEYS))


def health(chunks: DataFrame, state: DataFrame, dimensions: int) -> DataFrame:
    """files, status, dimension_mismatch and healthy in one row."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    s = state.agg(F.coalesce(pick("sync_status"), F.lit("idle")).alias("status"), pick("embedding_dimensions").alias("__d"))
    stored = F.expr("try_cast(__d as int)")
    mismatch = F.coalesce(stored != dimensions, F.lit(False))
    have = chunks.agg(F.count_distinct("file_path").alias("files"))
    return have.crossJoin(s).withColumn("dimension_mismatch", mismatch).withColumn("healthy", (F.col("files") > 0) & (F.col("status") != "error") & ~F.col("dimension_mismatch")).drop("__d")


def status_sentence(chunks: DataFrame, state: DataFrame, dimensions: int) -> DataFrame:
    """One line about the index: none yet, unusable (failed sync or other dimensions), or in use with its size."""
    h = health(chunks, state, dimensions).crossJoin(index_stats(chunks).select("chunks"))
    text = (
        F.when(F.col("files") == 0, "No index yet; the next session makes one.")
        .when(~F.col("healthy"), "The index can't be used; search by text and rebuild it if need be.")
        .otherwise(F.format_string("Hybrid search is on (%d files, %d chunks); ask it before searching by text.", "files", "chunks"))
    )
    return h.select(text.alias("sentence"))


def sync_record(state: DataFrame) -> DataFrame:
    """status, total, completed, current_file, error and last_sync of the sync in one row; texts that are no numbers count as 0."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    number = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract({k}, '^ *([-+]?[0-9]+)', 1) as int)"), F.lit(0)).alias
    row = state.agg(*(pick(k).alias(k) for k in ("sync_status", "sync_total_files", "sync_completed_files", "sync_current_file", "sync_error", "last_sync_time")))
    return row.select(
        F.coalesce("sync_status", F.lit("idle")).alias("status"), number("sync_total_files")("total"), number("sync_completed_files")("completed"), F.col("sync_current_file").alias("current_file"), F.col("sync_error").alias("error"), F.col("last_sync_time").alias("last_sync")
    )


def index_status(chunks: DataFrame, state: DataFrame, model: str, endpoint: str, path: str) -> DataFrame:
    """files_indexed, total_chunks, last_sync, path, embedding_model and embedding_endpoint in one row."""
    s = index_stats(chunks).crossJoin(sync_record(state).select("last_sync"))
    return s.select(F.col("files").alias("files_indexed"), F.col("chunks").alias("total_chunks"), "last_sync", F.lit(path).alias("path"), F.lit(model).alias("embedding_model"), F.lit(endpoint).alias("embedding_endpoint"))


def overview(chunks: DataFrame, state: DataFrame, files: DataFrame, eligible: Column, config: dict[str, object] | None = None, size_bytes: int = 0, path: str = "") -> DataFrame:
    """The whole report as one nested row: index (with its extensions, most frequent first), sync and config.

    Its list of files is `file_stats`, a table of its own, as it grows with the index.
    """
    extensions = extension_counts(chunks).agg(F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("n"), F.col("extension").alias("ext")))).alias("x"))
    listed = F.transform("x", lambda e: F.struct(e["ext"].alias("ext"), (-e["n"]).alias("count"))).alias("extensions")
    s, c = index_stats(chunks), coverage(chunks, files, eligible).select("eligible", "coverage_percent")
    out = s.crossJoin(c).crossJoin(extensions).crossJoin(sync_record(state))
    index = F.struct(F.col("files").alias("files_indexed"), F.col("chunks").alias("total_chunks"), F.col("eligible").alias("eligible_files"), "coverage_percent", "avg_chunks_per_file", listed, F.lit(size_bytes).cast("bigint").alias("size_bytes"), F.lit(path).alias("path"))
    return out.select(index.alias("index"), F.struct("status", "total", "completed", "current_file", "error", "last_sync").alias("sync"), F.create_map(*(F.lit(x if k == 0 else None if x is None else str(x)) for kv in (config or {}).items() for k, x in enumerate(kv))).cast("map<string,string>").alias("config"))
