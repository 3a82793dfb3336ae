"""Keeping the index in step with the files: differences, upserts, orphans, garbage, debounced runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """file_path and the hash its first chunk was stored with."""
    return chunks.groupBy("file_path").agg(F.min_by("file_hash", F.struct("chunk_index", "id")).alias("stored_hash"))


def changed_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files (file_path, content_hash) that are new or whose hash differs from the stored one, with `state` new or changed."""
    joined = files.select("file_path", "content_hash").join(stored_hashes(chunks), "file_path", "left")
    return joined.where(~F.col("content_hash").eqNullSafe(F.col("stored_hash"))).select("file_path", "content_hash", "stored_hash", F.when(F.col("stored_hash").isNull(), "new").otherwise("changed").alias("state"))


def gc_candidates(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that exist no more, with the number of their chunks."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_anti").groupBy("file_path").agg(F.count("*").alias("chunks"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both tables, the latest `version` of each key; at equal versions the new row."""
    both = old.select(*new.columns).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__new")


_BLOCK = 4096


def new_ids(keys: DataFrame, top: int | Column) -> DataFrame:
    """file_path, chunk_index and id for new chunks (file_path, chunk_index): the numbers after `top`, without gaps.

    Only these two columns move. A file's indexes are cut into blocks, which are numbered by
    themselves; where a block begins are prefix sums over block counts, and where a file does over
    file counts, so neither a large file nor the whole table is sorted in one task.
    """
    own = keys.select("file_path", "chunk_index", F.floor(F.col("chunk_index") / _BLOCK).alias("__k"), F.pmod(F.xxhash64("file_path"), F.lit(1024)).alias("__b"))
    blocks = own.groupBy("__b", "file_path", "__k").agg(F.count("*").alias("__n"))
    base = blocks.groupBy("__b").agg(F.sum("__n").alias("__m"))
    base = base.select("__b", (F.sum("__m").over(Window.orderBy("__b")) - F.col("__m")).alias("__base"))
    starts = blocks.withColumn("__before", F.sum("__n").over(Window.partitionBy("__b").orderBy("file_path", "__k")) - F.col("__n")).join(F.broadcast(base), "__b")
    starts = starts.select("file_path", "__k", (F.col("__base") + F.col("__before")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("file_path", "__k").orderBy("chunk_index"))
    return own.withColumn("__i", inside).join(starts, ["file_path", "__k"]).select("file_path", "chunk_index", ((F.lit(top) if isinstance(top, int) else top) + F.col("__start") + F.col("__i")).cast("bigint").alias("id"))


def upsert_chunks(old: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """Chunks by (file_path, chunk_index): a rewritten chunk keeps its id, new ones take ids after the largest there is (or after `top`, where `old` is only a part of the table)."""
    if top is None:
        top = int(old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    known = old.select("file_path", "chunk_index", "id")
    fresh = new_ids(new.select("file_path", "chunk_index").join(known.drop("id"), ["file_path", "chunk_index"], "left_anti"), top)
    ids = known.join(new.select("file_path", "chunk_index"), ["file_path", "chunk_index"], "left_semi").unionByName(fresh)
    kept = old.join(new.select("file_path", "chunk_index"), ["file_path", "chunk_index"], "left_anti")
    return kept.select(*old.columns).unionByName(new.drop("id").join(ids, ["file_path", "chunk_index"]).select(*old.columns))


def delete_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*chunks.columns)


def orphan_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks past the last chunk that their file has now."""
    last = new.groupBy("file_path").agg(F.max("chunk_index").alias("__last"))
    return old.join(last, "file_path").where(F.col("chunk_index") > F.col("__last")).select(*old.columns)


def replace_files(old: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """The table after the files of `new` were indexed again: upserted, and their orphans gone. `new` is read several times; stage it."""
    last = new.groupBy("file_path").agg(F.max("chunk_index").alias("__last"))
    both = upsert_chunks(old, new, top)
    return both.join(last, "file_path", "left").where(F.col("__last").isNull() | (F.col("chunk_index") <= F.col("__last"))).select(*old.columns)


def debounced(events: DataFrame, gap_ms: int, key: str = "user_id", at: str = "ts", id: str = "event_id") -> DataFrame:
    """The events that are accepted when each must come at least `gap_ms` after the last accepted one of its key.

    A fold over the key's times, in order; equal times by id. The fold reads sorted rows of a key as a
    stream of batches and keeps one time, so a key with a third of all rows needs no memory for its rows.
    """
    import pandas as pd

    rows = events.select(F.col(key).alias("k"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(id).alias("id")).where("k is not null and ms is not null")
    types = dict(rows.dtypes)
    ordered = rows.repartition("k").sortWithinPartitions("k", "ms", "id")

    def fold(batches):  # noqa: ANN001, ANN202
        now, last = None, None
        for b in batches:
            keep = []
            for k, ms in zip(b["k"], b["ms"], strict=True):
                ok = k != now or ms - last >= gap_ms
                if ok:
                    now, last = k, ms
                keep.append(ok)
            yield pd.DataFrame({key: b["k"][keep], id: b["id"][keep]})

    return ordered.mapInPandas(fold, f"{key} {types['k']}, {id} {types['id']}")


def listing_union(*listings: DataFrame) -> DataFrame:
    """Paths of several listings, each once."""
    out = listings[0].select("file_path")
    for x in listings[1:]:
        out = out.union(x.select("file_path"))
    return out.distinct()


def first_files(files: DataFrame, max_files: int | None, order: Column | None = None) -> DataFrame:
    """The listing cut to its first `max_files` paths, before any other rule looks at them; all of it without a number. Only paths are sorted."""
    if max_files is None or files.select("file_path").count() <= max_files:
        return files
    first = files.select("file_path").orderBy(order if order is not None else F.col("file_path")).limit(max_files)
    return files.join(first, "file_path", "left_semi")
