"""How distinctive a term is for its record (problem 6).

Parsimonious language model: a record's term counts are explained by a mixture of the collection's
term probabilities and the record's own. Expectation-maximisation moves mass that the collection
explains out of the record's model; what stays is characteristic of the record.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.session import staged

OWN_SHARE, ROUNDS, TOLERANCE = 0.1, 500, 1e-7
_RUN = re.compile(r"[A-Za-z0-9_$]+")


def count_terms(terms: list[str], text: str) -> list[int]:
    """How often each term stands in the text with no letter (A-Z, a-z), digit, `_` or `$` next to it."""
    seen = Counter(_RUN.findall(text))
    return [seen[t] if _RUN.fullmatch(t) else len(re.findall(r"(?<![A-Za-z0-9_$])" + re.escape(t) + r"(?![A-Za-z0-9_$])", text)) for t in terms]


def parsimonious(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, own: float = OWN_SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """P(term | record) for many records at once, and how many rounds each record took (-1 where `rounds` weren't enough).

    `tf` and `background` (P(term | collection)) lie one record after another; `starts` has where each
    begins. A record is done once no probability moves by `tolerance`, whatever records lie beside it.
    A record without any occurrence has probability 0 for all terms.
    """
    size = np.diff(np.append(starts, len(tf)))
    took = np.full(len(starts), -1)
    whole = np.add.reduceat(tf, starts) if len(starts) else np.zeros(0)
    p = tf / np.maximum(np.repeat(whole, size), 1e-300)
    live = np.arange(len(starts))
    at, s, t, b, q = np.arange(len(tf)), starts, tf, background, p
    for k in range(1, rounds + 1):
        e = t * (own * q) / ((1 - own) * b + own * q + 1e-300)
        new = e / np.maximum(np.repeat(np.add.reduceat(e, s), size), 1e-300)
        done = np.maximum.reduceat(np.abs(new - q), s) < tolerance
        q = new
        if done.any():
            over = np.repeat(done, size)
            p[at[over]] = q[over]
            took[live[done]] = k
            live, at, t, b, q, size = live[~done], at[~over], t[~over], b[~over], q[~over], size[~done]
            s = np.cumsum(size) - size
            if not len(live):
                return p, took
    p[at] = q
    return p, took


def term_scores(records: DataFrame, id: str = "id", terms: str = "identifiers", text: str = "chunk_text", own: float = OWN_SHARE) -> DataFrame:
    """A score for each term of each record.

    Terms are the blank-separated tokens of column `terms`, case kept. Result: id, term, tf (its
    occurrences in `text` with nothing of a word next to it), df (records that have the term), cf (its
    occurrences in all records), score (its probability in the record's parsimonious model; larger is
    more characteristic, the scores of a record sum to 1), background (its probability in the
    collection) and rounds (how many its record took to converge, -1 if it has not). A term that is in
    `terms` but not in `text` has tf 0 and score 0.

    Records without terms and null ids are left out; a null text counts as empty; rows with one id
    count once. An empty table gives an empty result.

    Background counts are aggregated map-side and joined by term (a hot term's join splits under
    adaptive skew handling); a record's terms meet again once, for the estimation.
    """
    rows = records.select(F.col(f"`{id}`").alias("id"), F.col(f"`{terms}`").alias("terms"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where("id is not null and trim(terms) <> ''")
    kind = dict(rows.dtypes)["id"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own_terms = [list(dict.fromkeys(x.split())) for x in b["terms"]]
            yield pd.DataFrame({"id": b["id"], "terms": own_terms, "tf": [count_terms(x, t) for x, t in zip(own_terms, b["t"], strict=True)]})

    counted = rows.mapInPandas(count, f"id {kind}, terms array<string>, tf array<int>").where("size(terms) > 0")
    once = staged(counted.groupBy("id").agg(F.first("terms").alias("terms"), F.first("tf").alias("tf")), "terms")
    long = once.select("id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
    background = long.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    total = F.lit(float(long.agg(F.sum("tf")).first()[0] or 1))
    met = long.join(background, "term").groupBy("id").agg(F.collect_list(F.struct("term", "tf", "df", "cf")).alias("x")).select("id", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), F.col("x.df").alias("df"), F.col("x.cf").alias("cf"), total.alias("total"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = [b.column(k).flatten() for k in (1, 2, 3, 4)]
            size = np.asarray(b.column(1).value_lengths())
            starts = np.cumsum(size) - size
            tf, cf = (np.asarray(x, dtype=float) for x in (flat[1], flat[3]))
            share = cf / b.column(5)[0].as_py()
            p, took = parsimonious(tf, share, starts, own)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([ids, *flat, pa.array(p), pa.array(share), pa.array(np.repeat(took, size).astype(np.int32))], names=["id", "term", "tf", "df", "cf", "score", "background", "rounds"])

    return met.mapInArrow(estimate, f"id {kind}, term string, tf int, df bigint, cf bigint, score double, background double, rounds int")
