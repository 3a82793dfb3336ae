"""Processing only new or changed records (problem 3).

State is a table of (key, content hash) in layers: a base and, for each later run, the keys that run
processed. A run joins the current rows with the state it started from, takes those that are new or
changed, and, once its work is done, writes one more layer and then makes it count by creating the
file of the next version's number, which lists the layers in force. That file is renamed into place
whole and never replaced: of two runs that began with one version only one can create it, and a run
that dies at any moment holds nothing that could stop a later one. Before the rename the old version
is in force, so the rows come again; after it they don't.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """A path with forward slashes and without leading `./`."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", "")


def completed_state(log: DataFrame, path: str = "file_path", content_hash: str = "file_hash", outcome: str = "outcome", at: str = "logged_at", run: str = "run_no", done: str = "committed") -> DataFrame:
    """What an append-only log says was completed: for each file the hash of its latest `done` row.

    Result: key, state_hash (lower case), once a key. Rows of one key aggregate map-side to a single
    maximum, so a key with a third of the log is no hot spot. Null paths are left out. A null hash or
    time loses against any other; equal times are decided by the later run, then the larger hash.
    """
    c = {k: F.col(f"`{v}`") for k, v in (("p", path), ("h", content_hash), ("o", outcome), ("t", at), ("r", run))}
    rows = log.where(c["o"] == F.lit(done)).select(plain_path(c["p"]).alias("key"), F.struct(c["t"].alias("t"), c["r"].alias("r"), F.lower(c["h"]).alias("h")).alias("last")).where("key is not null")
    return rows.groupBy("key").agg(F.max("last").alias("last")).select("key", F.col("last.h").alias("state_hash"))


def row_hash(*columns: str) -> Column:
    """A content hash over several columns in which null, empty text and shifted borders all differ."""
    parts = [F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def new_or_changed(rows: DataFrame, state: DataFrame, key: Column, content_hash: Column) -> DataFrame:
    """The rows of `rows` whose key and content hash are not together in `state`, with all their columns.

    `state` holds key and state_hash, as `completed_state` or `StateStore.read` give it; a key whose
    records carry several hashes has a row for each. Rows that are equal in every column come once. A
    null key is new each time; a null hash counts as changed unless the state has a null hash too.
    Letter case of hashes doesn't matter. The join is an anti join on key and hash, so rows are only
    dropped, never copied, and a hot key splits under adaptive skew handling.
    """
    tagged = rows.distinct().withColumns({"__key": key, "__hash": F.lower(content_hash)})
    known = state.select(F.col("key").alias("__known_key"), F.lower("state_hash").alias("__known_hash"))
    kept = tagged.join(known, (tagged["__key"] == known["__known_key"]) & tagged["__hash"].eqNullSafe(known["__known_hash"]), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in rows.columns])


def _names(content: object) -> Iterator[str]:
    """The folders that a version's content names, at any depth."""
    if isinstance(content, str):
        yield content.split("/")[0]
    elif isinstance(content, dict | list):
        for x in content.values() if isinstance(content, dict) else content:
            yield from _names(x)


_STATE = "key string, state_hash string, layer bigint"


@dataclass(frozen=True)
class StateStore:
    """Versions of a state table in one folder.

    `version-<n>` lists the layers of version n; layers are folders of (key, state_hash, layer), of
    which the latest one that has a key says all its hashes. After `max_layers` the next commit merges them.
    """

    spark: SparkSession
    folder: str
    max_layers: int = 16

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The number of the version in force, or None before the first commit."""
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not fs.exists(root):
            return None
        numbers = [int(n[8:]) for f in fs.listStatus(root) if (n := f.getPath().getName()).startswith("version-") and n[8:].isdigit()]
        return max(numbers, default=None)

    def content(self, version: int | None = None) -> dict:
        """What the file of a version says; of the one in force unless given."""
        jvm, fs = self._fs()
        v = self.version() if version is None else version
        if v is None:
            return {}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version-{v}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _layers(self, version: int | None) -> list[str]:
        return self.content(version).get("layers", []) if version is not None else []

    def read(self, version: int | None = None) -> DataFrame:
        """key and state_hash of the version in force (or of a given one); empty before the first commit."""
        return self._read(self._layers(self.version() if version is None else version)).select("key", "state_hash")

    def _read(self, layers: list[str]) -> DataFrame:
        if not layers:
            return self.spark.createDataFrame([], _STATE)
        rows = self.spark.read.schema(_STATE).parquet(*(f"{self.folder}/{x}" for x in layers))
        if len(layers) == 1:
            return rows
        # One number a key decides; rows of a key are not gathered, so a key with many hashes splits.
        last = rows.groupBy("key").agg(F.max("layer").alias("layer"))
        return rows.join(last, ["key", "layer"], "left_semi")

    def commit(self, processed: DataFrame, expected: int | None) -> int:
        """Make the next version: the state in force, in which the keys of `processed` (key, state_hash) have the hashes given there and no others.

        `expected` is the version the run began with. If another run has committed since, this one is
        refused, so two runs can't both claim the same rows. Only `processed` is written, but for the
        merge every `max_layers` commits. Null keys are left out.
        """
        if self.version() != expected:
            raise RuntimeError("another run has committed since this one began")
        number = 0 if expected is None else expected + 1
        layers = self._layers(expected)
        fresh = processed.where("key is not null").select(F.col("key").cast("string").alias("key"), F.lower("state_hash").alias("state_hash")).distinct().withColumn("layer", F.lit(number).cast("bigint"))
        name = f"layer-{number}-{uuid.uuid4().hex}"
        if len(layers) >= self.max_layers:
            old = self._read(layers).join(fresh.select("key").distinct(), "key", "left_anti").select("key", "state_hash", F.lit(number).cast("bigint").alias("layer"))
            fresh, layers = old.unionByName(fresh), []
        fresh.write.parquet(f"{self.folder}/{name}")
        self.publish(expected, {"layers": [*layers, name]})
        return number

    def publish(self, expected: int | None, content: dict) -> int:
        """Create the file of the version after `expected`; refused if it is there already. The draft is complete before it gets its name."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        number = 0 if expected is None else expected + 1
        draft = path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content | {"version": number}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else jvm.java.net.URI("file:///"), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(path(f"{self.folder}/version-{number}")), options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(path(f"{self.folder}/version-{number}")):
                raise RuntimeError("another run has committed since this one began") from e
            raise
        return number

    def vacuum(self, older_than_s: float = 7 * 86_400) -> int:
        """Delete folders that the version in force doesn't name, drafts, and files of earlier versions; how many folders.

        Only what was last written more than `older_than_s` ago goes, which must be longer than the
        longest run: younger folders may belong to a run that is still writing, or be read.
        """
        jvm, fs = self._fs()
        now = self.version()
        used = set(_names(self.content()))
        gone = 0
        for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.folder)):
            name = f.getPath().getName()
            stale = f.getModificationTime() <= (time.time() - older_than_s) * 1000
            if not stale or name in used:
                continue
            if f.isDirectory() and name.startswith(("layer-", "snapshot-")):
                fs.delete(f.getPath(), True)
                gone += 1
            elif name.startswith(".draft-") or (name.startswith("version-") and name != f"version-{now}"):
                fs.delete(f.getPath(), False)
        return gone


def run_once(store: StateStore, rows: DataFrame, key: Column, content_hash: Column, work: Callable[..., object]) -> int:
    """One incremental run: `work(changed_rows, number)` does the work; the state moves on only after it returns.

    `number` is the version this run will make. It is the same again for the run that follows a failed
    one, so work that writes to a place named after it (overwriting what is there) neither skips nor
    repeats a record, whenever a run dies. If `work` raises, nothing is committed and the next run sees
    the same rows. Of a changed record's key all present hashes are stored, so keys whose records carry
    several hashes settle. Gives the number of changed rows.
    """
    from lodeseek.session import staged

    began = store.version()
    changed = staged(new_or_changed(rows, store.read(began), key, content_hash), "changed")
    n = changed.count()
    if n:
        work(changed, 0 if began is None else began + 1)
        touched = changed.select(key.cast("string").alias("key")).where("key is not null").distinct()
        present = rows.select(key.cast("string").alias("key"), F.lower(content_hash).alias("state_hash")).distinct()
        store.commit(present.join(touched, "key", "left_semi"), began)
    return n
