"""Hybrid search: vector and word candidates joined, scaled, weighed and cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.paths import file_type_multiplier
from lodeseek.functions.scoring import min_max_best_low, rrf
from lodeseek.functions.text import identifier_boost
from lodeseek.operators.lexical import LexicalIndex, Scan, best_bm25
from lodeseek.operators.vector import vector_top_k
from lodeseek.session import staged

BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Weights:
    vector: float = 0.4
    bm25: float = 0.3
    rrf: float = 0.3


def fuse(vec: DataFrame, fts: DataFrame) -> DataFrame:
    """Full outer join of both candidate lists: similarity 0 and no rank where a list lacks the chunk, scaled bm25 and rrf."""
    v = vec.select("query_id", "id", "similarity", F.col("rank").alias("vec_rank"))
    f = fts.select("query_id", "id", "bm25", F.col("rank").alias("fts_rank"))
    both = v.join(f, ["query_id", "id"], "full_outer")
    scaled = min_max_best_low(F.col("bm25"), Window.partitionBy("query_id"))
    return both.select("query_id", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "vec_rank", "fts_rank", "bm25", F.coalesce(scaled, F.lit(0.0)).alias("bm25_scaled"), rrf(F.col("vec_rank"), F.col("fts_rank")).alias("rrf"))


def _with_text(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Text and path are joined only now, to the few candidates; up to BROADCAST_IDS of their ids are broadcast, so that other chunks' texts are not shuffled."""
    candidates = staged(candidates, "candidates")
    rows = chunks.select("id", "file_path", "chunk_text", "start_line", "end_line")
    if candidates.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(candidates.select("id").distinct()), "id", "left_semi")
    return candidates.join(rows, "id").join(queries.select("query_id", "query_text"), "query_id")


# Fixed value: what results say that were found by words because no query vector could be had.
WORDS_ONLY = "FTS-only result (embedding server unavailable)"


def _within(chunks: DataFrame, path_prefix: Column | None) -> DataFrame | None:
    return None if path_prefix is None else chunks.where(path_prefix).select("id")


def hybrid_search(chunks: DataFrame, index: LexicalIndex | Scan, queries: DataFrame, top_k: int = 10, threshold: float = 0.35, weights: Weights = Weights(), path_prefix: Column | None = None) -> DataFrame:
    """The best chunks of each query: query_id, id, file_path, start_line, end_line, similarity, score, place, chunk_text.

    `queries` has query_id, query_text and query_vector. A chunk stays if its similarity reaches the
    threshold, or if it has none but a score. Candidates are the 2 * top_k best of either list.
    """
    vec = vector_top_k(chunks, queries, 2 * top_k, path_prefix=path_prefix)
    fts = best_bm25(index, queries, 2 * top_k, within=_within(chunks, path_prefix))
    c = _with_text(fuse(vec, fts), chunks, queries)
    base = F.lit(weights.vector) * F.col("similarity") + F.lit(weights.bm25) * F.col("bm25_scaled") + F.lit(weights.rrf) * F.col("rrf")
    score = F.round(base * file_type_multiplier(F.col("file_path")) * identifier_boost(F.col("query_text"), F.col("chunk_text")), 12)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_rank").asc_nulls_last(), F.col("fts_rank").asc_nulls_last())
    kept = c.withColumn("score", score).where((F.col("similarity") >= threshold) | ((F.col("similarity") == 0) & (F.col("score") > 0)))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).select("query_id", "id", "file_path", "start_line", "end_line", "similarity", "score", "place", "chunk_text")


def word_search(chunks: DataFrame, index: LexicalIndex | Scan, queries: DataFrame, top_k: int = 10, path_prefix: Column | None = None) -> DataFrame:
    """Search by words only, as where no query vector can be had; same columns, similarity 0, and a note.

    The 2 * top_k best matches are scaled and weighed, and the top_k best of them stay.
    """
    fts = best_bm25(index, queries, 2 * top_k, within=_within(chunks, path_prefix))
    scaled = fts.withColumn("bm25_scaled", min_max_best_low(F.col("bm25"), Window.partitionBy("query_id")))
    c = _with_text(scaled, chunks, queries)
    score = F.round(F.col("bm25_scaled") * file_type_multiplier(F.col("file_path")) * identifier_boost(F.col("query_text"), F.col("chunk_text")), 12)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    placed = c.withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    return placed.select("query_id", "id", "file_path", "start_line", "end_line", F.lit(0.0).alias("similarity"), "score", "place", "chunk_text", F.lit(WORDS_ONLY).alias("note"))


def vector_search(chunks: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float = 0.35, path_prefix: Column | None = None) -> DataFrame:
    """Search by vectors only: the top_k best, of them those that reach the threshold."""
    vec = vector_top_k(chunks, queries, top_k, path_prefix=path_prefix).where(F.col("similarity") >= threshold)
    return vec.join(chunks.select("id", "file_path", "start_line", "end_line", "chunk_text"), "id").select("query_id", "id", "file_path", "start_line", "end_line", "similarity", F.col("rank").alias("place"), "chunk_text")
