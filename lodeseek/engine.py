"""The engine: index a corpus, keep it in step, and search it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek import config as C
from lodeseek.embedding import Embedder, HashEmbedder, embed_column, embed_queries, ping
from lodeseek.functions.paths import like_prefix
from lodeseek.functions.text import extract_identifiers
from lodeseek.operators import maintain, status
from lodeseek.operators.chunking import chunk_files
from lodeseek.operators.eligibility import should_index
from lodeseek.operators.fusion import Weights, hybrid_search, vector_search, word_search
from lodeseek.operators.merge import merge_adjacent, presented
from lodeseek.safety import SafetyLists
from lodeseek.schemas import CHUNKS, SCHEMA_VERSION
from lodeseek.session import staged
from lodeseek.sources.warehouse import BUCKETS, Warehouse


class DimensionError(RuntimeError):
    pass


def _iso(at: datetime | None) -> str:
    return (at or datetime.now(UTC)).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class Engine:
    spark: SparkSession
    folder: str
    embedder: Embedder = field(default_factory=HashEmbedder)
    settings: dict[str, Any] = field(default_factory=lambda: C.DEFAULTS)
    ignored: list[str] = field(default_factory=list)
    job_group: str = "lodeseek-sync"
    root: str = ""
    safety: SafetyLists | None = None
    buckets: int = BUCKETS

    @property
    def warehouse(self) -> Warehouse:
        return Warehouse(self.spark, self.folder, self.buckets)

    def _get(self, path: str) -> Any:
        return C.get(self.settings, path)

    def eligible(self) -> Column:
        return should_index(F.col("file_path"), F.col("size_bytes"), self._get("indexing.include"), self._get("indexing.exclude"), self.ignored, self._get("indexing.max_file_size_kb"))

    def index_files(self, files: DataFrame) -> DataFrame:
        """Chunks, with ids left open, of files (file_path, content)."""
        hashed = files.select("file_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
        cut = chunk_files(hashed, strategy=self._get("chunking.strategy"), max_tokens=self._get("chunking.max_tokens"), overlap_tokens=self._get("chunking.overlap_tokens"))
        full = embed_column(cut, "chunk_text", "embedding", self.embedder)
        return full.select(F.lit(None).cast("bigint").alias("id"), "file_path", "chunk_index", "chunk_text", "start_line", "end_line", "embedding", "file_hash", extract_identifiers(F.col("chunk_text")).alias("identifiers"), F.current_timestamp().alias("updated_at")).select(*(f.name for f in CHUNKS.fields))

    def _failed(self, outcome: str, message: str) -> dict[str, Any]:
        self.warehouse.commit(values={"sync_status": "error", "sync_error": message})
        return {"outcome": outcome, "status": "error", "error": message}

    def sync(self, files: DataFrame, force: bool = False, now: datetime | None = None, parts: int = 1, fresh_index: bool = False, on_progress: Callable[[dict[str, str]], None] | None = None) -> dict[str, Any]:
        """Bring the index in step with `files` (file_path, content, size_bytes), the whole listing. Files that are gone from it are dropped.

        At most `indexing.max_files` files of the listing are looked at, in order of path; files beyond
        keep what is stored of them. An index that can't be read is made anew. With `parts`
        the changed files are indexed and committed in so many steps, and the state says how many are
        done. Outcomes: blacklisted, auto-index-disabled, dimension-mismatch, embedder-unreachable, ok;
        the state is in_progress meanwhile, then idle, or error with a message.
        """
        if self.safety and self.root and self.safety.is_blacklisted(self.root):
            return {"outcome": "blacklisted", "status": "skipped"}
        if not force and not self._get("indexing.auto_index"):
            return {"outcome": "auto-index-disabled", "status": "skipped"}
        w = self.warehouse
        recreated = w.exists() and not w.readable()
        if recreated:
            w.clear()
        if not fresh_index and (stored := self._other_dimensions()):
            return self._failed("dimension-mismatch", f"Dimension mismatch: stored={stored}, config={self.embedder.dimensions}")
        if not ping(self.embedder):
            return self._failed("embedder-unreachable", "Embedding endpoint unreachable")
        w.migrate()
        at = _iso(now)
        self.spark.sparkContext.setJobGroup(self.job_group, "sync", True)
        try:
            w.commit(values={"sync_status": "in_progress", "sync_started_at": at, "sync_error": None})
            old = self.spark.createDataFrame([], CHUNKS) if fresh_index else w.read("chunks")
            live = maintain.first_files(files, self._get("indexing.max_files")).where(self.eligible()).select("file_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
            todo = live if force or fresh_index else live.join(maintain.changed_files(live, old).select("file_path"), "file_path", "left_semi")
            step = F.pmod(F.xxhash64("file_path", F.lit(5)), F.lit(parts))
            paths = staged(todo.select("file_path", step.alias("step")), "todo")
            sizes = {r.step: r["count"] for r in paths.groupBy("step").count().collect()}  # at most `parts` numbers
            total, done = sum(sizes.values()), 0
            gone = staged(old.select("file_path").distinct().join(files.select("file_path").distinct(), "file_path", "left_anti"), "gone")
            for k in range(parts):
                values = {"sync_total_files": str(total), "sync_completed_files": str(done), "sync_current_file": f"part {k + 1} of {parts}"}
                w.commit(values=values)
                if on_progress:
                    on_progress(w.state())
                fresh = staged(self.index_files(todo.where(step == k).select("file_path", "content")), "fresh") if sizes.get(k) else None
                replace = fresh_index and k == 0
                if fresh is not None or replace or (k == 0 and not gone.isEmpty()):
                    w.commit(fresh, gone if k == 0 else None, replace=replace)
                done += sizes.get(k, 0)
            dropped = dict.fromkeys(status.PROGRESS_KEYS)
            w.commit(values=dropped | {"last_sync_time": at, "sync_status": "idle", "embedding_dimensions": str(self.embedder.dimensions), "schema_version": str(SCHEMA_VERSION)})
            return {"outcome": "ok", "status": "idle", "indexed_files": total, "at": at, "recreated": recreated}
        except Exception as e:
            w.commit(values={"sync_status": "error", "sync_error": str(e)[:500]})
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def reindex(self, files: DataFrame) -> dict[str, Any]:
        """Everything anew; the old index answers until the new one is there."""
        return self.sync(files, force=True, fresh_index=True)

    def reembed(self, files: DataFrame) -> str:
        """One or a few files anew: skipped (not eligible or no index), unchanged, empty (no chunks) or reembedded."""
        w = self.warehouse
        fit = files.where(self.eligible())
        if not w.exists() or fit.isEmpty():
            return "skipped"
        self._check_dimensions()
        old = w.read("chunks")
        hashed = fit.select("file_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
        changed = maintain.changed_files(hashed, old)
        if changed.isEmpty():
            return "unchanged"
        fresh = staged(self.index_files(hashed.join(changed.select("file_path"), "file_path", "left_semi")), "fresh")
        if fresh.isEmpty():
            return "empty"
        w.commit(fresh)
        return "reembedded"

    def collect_garbage(self, files: DataFrame, now_ms: int, gap_ms: int = 60_000) -> str:
        """Drop chunks of files that exist no more, at most once in `gap_ms`: skipped, debounced or removed:n."""
        w = self.warehouse
        if not w.exists():
            return "skipped"
        last = w.state().get("last_gc_time")
        if last and last.isdigit() and now_ms - int(last) < gap_ms:
            return "debounced"
        gone = staged(maintain.gc_candidates(w.read("chunks"), files), "gone")
        n = gone.count()
        w.commit(gone=gone if n else None, values={"last_gc_time": str(now_ms)})
        return f"removed:{n}"

    def terminate(self) -> dict[str, str]:
        """End a running sync and clean its state: no_process, terminated, or cleaned (the state spoke of a sync that isn't running). Nothing half-done is left: a version counts only once it is complete."""
        running = self.spark.sparkContext.statusTracker().getJobIdsForGroup(self.job_group)
        active = set(self.spark.sparkContext.statusTracker().getActiveJobsIds()) & set(running)
        w = self.warehouse
        if not active and w.state().get("sync_status") != "in_progress":
            return {"status": "no_process", "message": "No sync is running."}
        self.spark.sparkContext.cancelJobGroup(self.job_group)
        w.commit(values=dict.fromkeys(status.PROGRESS_KEYS) | {"sync_status": "idle"})
        return {"status": "terminated", "message": "The sync was ended and its state cleaned."} if active else {"status": "cleaned", "message": "No sync was running; its state was cleaned."}

    def _other_dimensions(self) -> str | None:
        stored = self.warehouse.state().get("embedding_dimensions")
        return stored if stored and stored.isdigit() and int(stored) != self.embedder.dimensions else None

    def _check_dimensions(self) -> None:
        if stored := self._other_dimensions():
            raise DimensionError(f"the index has {stored} dimensions, the embedder {self.embedder.dimensions}; reindex first")

    def search(self, queries: DataFrame, top_k: int | None = None, threshold: float | None = None, path: str | None = None, hybrid: bool | None = None, merged: bool = True) -> DataFrame:
        """Results of a batch of queries (query_id, query_text). Words alone are searched, with a note, if the embedder fails on the driver or on an executor."""
        self._check_dimensions()
        k = self._get("search.top_k") if top_k is None else top_k
        t = self._get("search.similarity_threshold") if threshold is None else threshold
        w, prefix = self.warehouse, like_prefix(F.col("file_path"), path)
        chunks = w.read("chunks")
        try:
            asked = staged(embed_queries(queries, self.embedder, self._get("embedding.query_prefix")), "queries")
        except Exception:  # noqa: BLE001  (a worker's failure comes as one of several classes)
            hits = word_search(chunks, w.index(), queries, k, prefix)
            return merge_adjacent(hits) if merged else hits
        if not (self._get("search.hybrid.enabled") if hybrid is None else hybrid):
            hits = vector_search(chunks, asked, k, t, prefix)
        else:
            h = "search.hybrid.weight_"
            hits = hybrid_search(chunks, w.index(), asked, k, t, Weights(self._get(h + "vector"), self._get(h + "bm25"), self._get(h + "rrf")), prefix)
        return merge_adjacent(hits) if merged else hits

    def matches(self, queries: DataFrame, **kw) -> DataFrame:  # noqa: ANN003
        """The results of `search`, merged, in the form that is shown."""
        return presented(self.search(queries, **kw))

    def _config(self) -> dict[str, Any]:
        return C.summary(self.settings, self.folder)

    def status(self) -> DataFrame:
        w, c = self.warehouse, self._config()
        return status.index_status(w.read("chunks"), w.read("sync_state"), c["model"], c["endpoint"], self.folder)

    def health(self) -> DataFrame:
        w = self.warehouse
        return status.health(w.read("chunks"), w.read("sync_state"), self.embedder.dimensions)

    def overview(self, files: DataFrame) -> DataFrame:
        w = self.warehouse
        return status.overview(w.read("chunks"), w.read("sync_state"), maintain.first_files(files, self._get("indexing.max_files")), self.eligible(), self._config(), w.size_bytes(), self.folder)

    def file_list(self) -> DataFrame:
        """path, chunks and last_updated of every indexed file, latest first."""
        return status.file_stats(self.warehouse.read("chunks"))

    def sentence(self) -> DataFrame:
        w = self.warehouse
        return status.status_sentence(w.read("chunks"), w.read("sync_state"), self.embedder.dimensions)
