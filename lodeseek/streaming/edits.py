"""Streams of host events: routing, edits applied to the index, debounced maintenance runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lodeseek.session import staged
from lodeseek.sources.warehouse import Warehouse


def route(events: DataFrame, kind: str = "type", properties: str = "properties") -> DataFrame:
    """action (sync or reembed) and file_path of the events that call for one; others are dropped. Works on streams."""
    p: Callable[[str], Column] = lambda k: F.try_element_at(F.col(properties), F.lit(k))
    action = F.when(F.col(kind) == "session.created", "sync").when(F.col(kind) == "file.edited", "reembed")
    path = F.when(action == "reembed", F.coalesce(p("filePath"), p("file"), F.lit("")))
    return events.withColumn("action", action).where(F.col("action").isNotNull()).withColumn("file_path", path)


def latest_edits(edits: DataFrame, key: str = "file_path", version: str = "content_version") -> DataFrame:
    """The last edit of each file; of edits with one version, one. Only each file's largest version is kept by a partition before the shuffle."""
    rest = [c for c in edits.columns if c not in (key, version)]
    last = edits.groupBy(key).agg(F.max(F.struct(F.col(version), *map(F.col, rest))).alias("last"))
    return last.select(*(F.col(f"last.{c}").alias(c) if c != key else F.col(key) for c in edits.columns))


def apply_edits(stream: DataFrame, warehouse: Warehouse, index_files: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index the last edit of each file of every micro-batch. `index_files` makes chunks of (file_path, content).

    The batch number is kept in sync_state within the same commit, so a batch that is delivered again
    after a failure changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        done = warehouse.state().get("stream_batch")
        if done and done.isdigit() and int(done) >= number:
            return
        fresh = staged(index_files(latest_edits(rows).where("file_path <> ''")), "edits")
        warehouse.commit(fresh, values={"stream_batch": str(number)})

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


class Debounce(StatefulProcessor):
    """Accepts an event of a key if it comes at least `gap_ms` after the last accepted one."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        # Two numbers an event are held, however a key's events of the micro-batch come in.
        times, ids = (np.concatenate(x) for x in zip(*((b["ms"].to_numpy(), b["event_id"].to_numpy()) for b in rows), strict=True))
        out, order = [], np.lexsort((ids, times))
        for ms, event in zip(times[order], ids[order], strict=True):
            if last is None or ms - last >= self.gap_ms:
                last = int(ms)
                out.append(int(event))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out})

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, gap_ms: int) -> DataFrame:
    """user_id and event_id of the accepted events of a stream with user_id, ts, event_id, in order of arrival by micro-batch."""
    keyed = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return keyed.groupBy("user_id").transformWithStateInPandas(Debounce(gap_ms), "user_id bigint, event_id bigint", "Append", "None")
