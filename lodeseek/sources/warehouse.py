"""The index on disk: chunks, their word index and the sync state, in versions that are swapped whole."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodeseek.functions.text import extract_identifiers
from lodeseek.operators.incremental import StateStore
from lodeseek.operators.lexical import POSTINGS, LexicalIndex, posting_rows
from lodeseek.operators.maintain import delete_files, replace_files
from lodeseek.schemas import CHUNKS, SCHEMA_VERSION, SYNC_STATE
from lodeseek.session import file_system, staged

BUCKETS = 64


class WarehouseError(RuntimeError):
    """The index names files that can't be read."""


@dataclass(frozen=True)
class Warehouse:
    """chunks, postings and sync_state under one folder.

    Chunks lie in `buckets` parts by file, each with its own postings, sorted by term. A commit writes
    only the parts whose files it touches and publishes a version that names the new parts beside the
    untouched old ones. A version is never changed; readers keep the one they opened.
    """

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    @property
    def store(self) -> StateStore:
        return StateStore(self.spark, self.folder)

    def exists(self) -> bool:
        return self.store.version() is not None

    def _paths(self, content: dict, name: str, only: set[int] | None = None) -> list[str]:
        parts = content.get(name) or {}
        return [f"{self.folder}/{p}" for b, p in parts.items() if only is None or int(b) in only]

    def _table(self, paths: list[str], schema) -> DataFrame:  # noqa: ANN001
        if not paths:
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(*paths)
        except AnalysisException as e:
            raise WarehouseError(f"{self.folder} can't be read") from e

    def read(self, name: str) -> DataFrame:
        """A table of the version in force; an empty one before the first commit. A version that can't be read is an error, never an empty table."""
        content = self.store.content()
        if name == "sync_state":
            return self.spark.createDataFrame(list((content.get("sync_state") or {}).items()), SYNC_STATE)
        return self._table(self._paths(content, name), {"chunks": CHUNKS, "postings": POSTINGS}[name])

    def state(self) -> dict[str, str]:
        return self.store.content().get("sync_state") or {}

    def index(self) -> LexicalIndex:
        """The word index of the version in force; its figures are kept with it."""
        content = self.store.content()
        n = content.get("figures") or {}
        return LexicalIndex(self._table(self._paths(content, "postings"), POSTINGS), sum(x[0] for x in n.values()), sum(x[1] for x in n.values()))

    def readable(self) -> bool:
        try:
            self.read("chunks")
            self.index()
        except WarehouseError:
            return False
        return True

    def commit(self, fresh: DataFrame | None = None, gone: DataFrame | None = None, values: dict[str, str | None] | None = None, replace: bool = False) -> int:
        """The next version: files of `fresh` (chunks with open ids) indexed again, files of `gone` dropped, state entries put (None drops one).

        With `replace` nothing of the version in force is kept but its state. Refused if another commit
        came between. `fresh` should be staged, as it is read several times.
        """
        store = self.store
        before, content = store.version(), store.content()
        out = {k: {} if replace and k != "sync_state" else dict(content.get(k) or {}) for k in ("chunks", "postings", "figures", "sync_state")}
        out["next_id"] = 1 if replace else content.get("next_id", 1)
        out["buckets"] = self.buckets if replace else content.get("buckets", self.buckets)  # an index keeps the number it began with
        for k, v in (values or {}).items():
            if v is None:
                out["sync_state"].pop(k, None)
            else:
                out["sync_state"][k] = v
        if fresh is not None or gone is not None:
            self._write(out, fresh, gone)
        return store.publish(before, out)

    def _write(self, out: dict, fresh: DataFrame | None, gone: DataFrame | None) -> None:
        bucket = F.pmod(F.xxhash64("file_path"), F.lit(out["buckets"])).cast("int")
        paths = [x.select("file_path") for x in (fresh, gone) if x is not None]
        every = paths[0] if len(paths) == 1 else paths[0].unionAll(paths[1])
        touched = {r.b for r in every.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` numbers
        rows = self._table(self._paths(out, "chunks", touched), CHUNKS)
        if gone is not None:
            rows = delete_files(rows, gone)
        if fresh is not None:
            rows = replace_files(rows, fresh, out["next_id"] - 1)
        folder = f"snapshot-{uuid.uuid4().hex}"
        names = [f.name for f in CHUNKS.fields]
        rows.select(*names, bucket.alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/chunks")
        for k in ("chunks", "postings", "figures"):
            out[k] = {b: p for b, p in out[k].items() if int(b) not in touched}
        written = self.spark.read.schema(StructType([*CHUNKS.fields, StructField("bucket", IntegerType())])).parquet(f"{self.folder}/{folder}/chunks")
        posting_rows(written, bucket=F.col("bucket")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/postings")
        stored = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{folder}/postings")
        for r in stored.where("term = ''").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("dl").alias("words"), F.max("id").alias("top")).collect():
            b = str(r.bucket)
            out["chunks"][b], out["postings"][b], out["figures"][b] = f"{folder}/chunks/bucket={b}", f"{folder}/postings/bucket={b}", [r.n, r.words]
            out["next_id"] = max(out["next_id"], r.top + 1)

    def migrate(self) -> bool:
        """Bring an index of an earlier schema up to date: identifiers and postings of all chunks are made anew. Whether there was anything to do."""
        found = int(self.state().get("schema_version") or 1)
        if not self.exists() or found >= SCHEMA_VERSION:
            return False
        old = self.read("chunks")
        self.commit(staged(old.withColumn("identifiers", extract_identifiers(F.col("chunk_text"))), "migrated"), values={"schema_version": str(SCHEMA_VERSION)})
        return True

    def size_bytes(self) -> int:
        """Bytes of the files that the version in force names."""
        total, content = 0, self.store.content()
        for name in ("chunks", "postings"):
            for p in self._paths(content, name):
                fs, path = file_system(self.spark, p)
                total += fs.getContentSummary(path).getLength()
        return total

    def clear(self) -> None:
        fs, path = file_system(self.spark, self.folder)
        fs.delete(path, True)
