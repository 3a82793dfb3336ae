"""Embedders: a table of known vectors, a hashing one that needs no model, and a remote service."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbedderError(RuntimeError):
    pass


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed feature hashing of words and word pairs, with unit length: the same text gives the same vector anywhere."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        words = text.lower().split()
        v = np.zeros(self.dimensions)
        for w in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


class HttpEmbedder:
    """A service with the usual embeddings interface: batches, a time limit, up to three attempts with growing waits."""

    def __init__(self, api_base: str, model: str, dimensions: int, batch_size: int = 10, api_key_env: str = "", timeout: float = 30, retries: int = 2, backoff: float = 1.0, post: Callable[[str, bytes, dict[str, str], float], bytes] | None = None) -> None:
        self.api_base, self.model, self.dimensions, self.batch_size, self.api_key_env = api_base, model, dimensions, batch_size, api_key_env
        self.timeout, self.retries, self.backoff, self.post = timeout, retries, backoff, post or _post

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.batch_size):
            out += self._batch(texts[k : k + self.batch_size])
        return out

    def _batch(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"}
        if self.api_key_env and os.environ.get(self.api_key_env):
            headers["Authorization"] = f"Bearer {os.environ[self.api_key_env]}"
        body = json.dumps({"model": self.model, "input": texts, "dimensions": self.dimensions}).encode()
        for attempt in range(self.retries + 1):
            try:
                data = json.loads(self.post(f"{self.api_base.rstrip('/')}/embeddings", body, headers, self.timeout))["data"]
                vectors = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
                if len(vectors) != len(texts):
                    raise EmbedderError("the service gave another number of vectors")
                return vectors
            except Exception as e:  # noqa: BLE001
                if attempt == self.retries:
                    raise EmbedderError(f"embedding failed after {attempt + 1} attempts: {e}") from e
                time.sleep(self.backoff * 4**attempt)
        raise AssertionError


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:  # noqa: S310
        return r.read()


def embed_column(rows: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    """`rows` with the vector of column `text` in `out`, one call for each Arrow batch; null texts get none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            have = s.notna()
            vectors = iter(embedder.embed(s[have].tolist()) if have.any() else [])
            yield pd.Series([np.asarray(next(vectors), np.float32) if h else None for h in have], dtype=object)

    return rows.withColumn(out, run(F.col(text)))


def embed_queries(queries: DataFrame, embedder: Embedder, prefix: str = "", text: str = "query_text", out: str = "query_vector") -> DataFrame:
    return embed_column(queries.withColumn("__q", F.concat(F.lit(prefix), F.col(text))), "__q", out, embedder).drop("__q")


def ping(embedder: Embedder) -> bool:
    try:
        return len(embedder.embed(["ping"])) == 1
    except EmbedderError:
        return False


def lookup_vectors(rows: DataFrame, vectors: DataFrame, key: str, out: str = "query_vector") -> DataFrame:
    """The precomputed vector of each row's key, from `vectors` (key, vector)."""
    return rows.join(vectors.select(F.col("key").alias(key), F.col("vector").alias(out)), key, "left")
