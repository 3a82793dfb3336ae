"""Merging neighbouring hits of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.scoring import fixed3
from lodeseek.functions.text import preview

GAP = 5


def merge_adjacent(hits: DataFrame, gap: int = GAP, group: str = "query_id") -> DataFrame:
    """Hits of one query and file that start at most `gap` lines after the end of the ones before become one.

    Scores are taken with three decimals, as results show them; the merged hit has the largest
    similarity and score, and the preview and note of its first chunk. Hits without a score (by vectors
    alone) are ordered by similarity. Result: query_id, file_path, start_line, end_line, similarity,
    score, preview, note, place.
    """
    for name, kind in (("score", "double"), ("note", "string")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    w = Window.partitionBy(group, "file_path").orderBy("start_line", "end_line", "id")
    so_far = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(so_far.isNull() | (F.col("start_line") > so_far + gap), 1).otherwise(0)
    islands = hits.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    merged = islands.groupBy(group, "file_path", "island").agg(
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.max(F.round("similarity", 3)).alias("similarity"),
        F.max(F.round("score", 3)).alias("score"),
        F.min_by(preview(F.col("chunk_text")), F.struct("start_line", "end_line", "id")).alias("preview"),
        F.min_by("note", F.struct("start_line", "end_line", "id")).alias("note"),
    )
    order = Window.partitionBy(group).orderBy(F.desc(F.coalesce("score", "similarity")), "file_path", "start_line")
    return merged.withColumn("place", F.row_number().over(order)).select(group, "file_path", "start_line", "end_line", "similarity", "score", "preview", "note", "place")


def presented(hits: DataFrame, group: str = "query_id") -> DataFrame:
    """Merged hits as results show them: file, lines ("start-end"), similarity and score as text with three decimals (score null where there is none), preview, note and place."""
    return hits.select(group, F.col("file_path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), fixed3(F.col("similarity")).alias("similarity"), F.when(F.col("score").isNotNull(), fixed3(F.col("score"))).alias("score"), "preview", "note", "place")
