"""Exact vector search: every chunk against a stated set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.lexical import best
from lodeseek.session import spread, staged

BLOCK_BYTES = 16 << 20
_AT_ONCE = 256  # queries in a table of similarities


def _by_length(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length; one gather of the flat buffer for each."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.list_(pa.float64()))
    size = np.asarray(a.value_lengths(), dtype=np.int64)
    flat = np.asarray(a.flatten(), dtype=float)
    begin = np.cumsum(size) - size
    return [(at := np.flatnonzero(size == n), flat.reshape(-1, n) if len(at) == len(size) and n else flat[begin[at][:, None] + np.arange(n)]) for n in np.unique(size)]


def similarities(asked: list[tuple[np.ndarray, np.ndarray]], own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Cosines of two sets of vectors over their common lengths, one matrix product for each pair of lengths; 0 where either has no length."""
    out = np.full((sum(len(x) for x, _ in asked), sum(len(x) for x, _ in own)), 0.0)
    for to, y in asked:
        for at, x in own:
            d = min(x.shape[1], y.shape[1])
            norm = np.linalg.norm(y[:, :d], axis=1)[:, None] * np.linalg.norm(x[:, :d], axis=1)[None, :]
            out[np.ix_(to, at)] = np.divide(y[:, :d] @ x[:, :d].T, norm, out=np.zeros_like(norm), where=norm > 0)
    return out


def _best_of(names: pa.Array, ids: pa.Array, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """The rows of a table of similarities that may be among the k best of their query."""
    if sims.shape[1] > k:
        low = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        i, j = np.nonzero(sims >= low - 1e-12)
    else:
        i, j = np.indices(sims.shape).reshape(2, -1)
    return pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sims[i, j])], names=["query_id", "id", "similarity"])


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int = 20, id: str = "id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", path_prefix: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, id, similarity and rank of the k chunks with the largest cosine for each query; ties by id.

    Vectors are compared over their common length; zero vectors have similarity 0. Up to `block_bytes`
    of query vectors are broadcast, and each Arrow batch of chunks is one matrix product and leaves only
    its own k best for each query, so the shuffle carries k rows for each query and batch and no text. A
    larger query set stays a table: it is cut into blocks of that size, and a grid of tasks compares
    each block with each part of the chunks.
    """
    spark = chunks.sparkSession
    rows = chunks if path_prefix is None else chunks.where(path_prefix)
    rows = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = staged(queries.select(F.col(f"`{query_id}`").alias("q"), F.col(f"`{query_vector}`").cast("array<double>").alias("v")).where("q is not null and v is not null"), "asked")
    schema = f"query_id {dict(asked.dtypes)['q']}, id {dict(rows.dtypes)['id']}, similarity double"
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    if not size:
        found = spark.createDataFrame([], schema)
    elif size <= block_bytes:
        found = _by_broadcast(spark, rows, asked, k, schema)
    else:
        found = _by_grid(rows, asked, k, schema, -(-size // block_bytes))
    # Equal vectors can differ in the last bit between matrix shapes; 12 digits make their order the ids'.
    return best(found.withColumn("similarity", F.round("similarity", 12)), "similarity", k, ascending=False)


def _by_broadcast(spark: SparkSession, rows: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    block = asked.toArrow()
    names = block.column(0).combine_chunks()
    shared = spark.sparkContext.broadcast([(names.slice(a, _AT_ONCE), _by_length(block.column(1).slice(a, _AT_ONCE))) for a in range(0, len(names), _AT_ONCE)])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = _by_length(b.column(1))
                for names, vectors in shared.value:
                    yield _best_of(names, b.column(0), similarities(vectors, own), k)

    return rows.mapInArrow(op, schema)


def _by_grid(rows: DataFrame, asked: DataFrame, k: int, schema: str, blocks: int) -> DataFrame:
    parts = spread(rows.sparkSession)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    right = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([a.column("q").slice(0, 0), b.column("id").slice(0, 0), pa.array([], pa.float64())], names=["query_id", "id", "similarity"])
        names, ids, own = a.column("q").combine_chunks(), b.column("id").combine_chunks(), _by_length(b.column("v"))
        out = []
        for at in range(0, a.num_rows, _AT_ONCE):
            out.append(_best_of(names.slice(at, _AT_ONCE), ids, similarities(_by_length(a.column("v").slice(at, _AT_ONCE)), own), k))
        return pa.Table.from_batches(out)

    cell = lambda x: x.repartition(parts * blocks, "block", "part").groupBy("block", "part")
    return cell(left).cogroup(cell(right)).applyInArrow(meet, schema)
