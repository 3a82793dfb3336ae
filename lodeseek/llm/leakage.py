"""Evaluation items that leak into a corpus (problem 8).

The items are the stated query set. Their word n-grams, rarest first, are the seeds: by the pigeonhole
rule a document that holds enough of an item must hold one of the item's rarest grams, so only those
are looked up, and no true leak is lost. Documents are folded to one form (see `lookalike`), cut into
words and hashed on whole Arrow batches; documents with a seed are counted against all grams of the
item and, above the count that any leak must reach, aligned word by word (Smith-Waterman). The
alignment's score decides: below what a run of the least length or an edited whole must score, the
pair is dropped; above it, longest run and edits are measured.

Items of up to `block_words` words, however many, are broadcast, and the corpus is read once and never
shuffled. Beyond that bound seeds are a table, joined with the grams of the documents; only pairs that
meet are brought together with their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.lookalike import code_points, fold_code_points
from lodeseek.session import staged

RUN, GRAM, WORDS_PER_REPLACEMENT, BLOCK_WORDS = 15, 5, 8, 2_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, whether a code point is part of a word, and whether it is a word by itself."""
    low = np.arange(0x110000, dtype=np.uint32)
    inside, alone = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in range(0x30000):
        ch = chr(c)
        inside[c] = ch.isalnum()
        if len(x := ch.lower()) == 1:
            low[c] = ord(x)
    for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)):
        alone[a : b + 1] = inside[a : b + 1]
    return low, inside, alone


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    ends: np.ndarray  # of each row, as places in `hashes`, beginning with 0


def words(texts: pa.Array) -> Words:
    """The words of each text as 64-bit hashes, after folding, without case and punctuation."""
    low, inside, alone = _letters()
    cp, offsets = fold_code_points(*code_points(texts))
    cp = low[cp]
    part = inside[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[offsets] = True
    single = alone[cp]
    begins = part & (edge[:-1] | single | ~np.concatenate([[False], part[:-1]]) | np.concatenate([[False], single[:-1]]))
    first = np.flatnonzero(begins)
    if not len(first):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    word = np.cumsum(begins) - 1
    place = np.arange(len(cp)) - first[np.maximum(word, 0)]
    place[~part] = 0
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _A, np.uint64))
    value = np.where(part, (cp.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0))
    h = np.add.reduceat(value, first)
    h = (h ^ (h >> np.uint64(29))) * _B
    return Words(h, np.searchsorted(first, offsets))


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words."""
    if len(h) < q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - q + 1, np.uint64)
    for i in range(q):
        out = out * _A + h[i : len(h) - q + 1 + i]
    return (out ^ (out >> np.uint64(31))) * _B


class Item(NamedTuple):
    item_id: int
    hashes: np.ndarray
    q: int  # words in a gram
    least: int  # different grams that any leak has in common with the item


def make_item(item_id: int, h: np.ndarray, run: int, gram: int, per: int) -> Item:
    """An item with its gram length and the number of different grams that any leak shares with it: that of the run with the fewest, or of the whole without those that edits can touch."""
    n, k = len(h), len(h) // per
    q = max(1, min(gram, n // (k + 1), min(run, n)))
    g, width = grams(h, q), min(run, n) - q + 1
    poorest = min(len(set(g[a : a + width].tolist())) for a in range(len(g) - width + 1))
    return Item(item_id, h, q, max(1, min(poorest, len(set(g.tolist())) - q * k)))


def needed_score(n: int, run: int, per: int) -> int:
    """What the alignment of any leak of an item of n words scores at least: a run, or the whole with each edit costing a match and a mismatch."""
    return min(2 * min(run, n), 2 * n - 3 * (n // per))


def seed_table(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each gram length the sorted seeds and their items. Of an item's grams, those that occur in the fewest items."""
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, it in enumerate(items):
        by_q.setdefault(it.q, []).append((k, np.unique(grams(it.hashes, it.q))))
    out = {}
    for q, own in by_q.items():
        every, times = np.unique(np.concatenate([g for _, g in own]), return_counts=True)
        seed, owner = [], []
        for k, g in own:
            rare = g[np.argsort(times[np.searchsorted(every, g)], kind="stable")][: max(1, len(g) - items[k].least + 1)]
            seed.append(rare)
            owner.append(np.full(len(rare), k))
        seed, owner = np.concatenate(seed), np.concatenate(owner)
        order = np.argsort(seed, kind="stable")
        out[q] = (seed[order], owner[order])
    return out


class Alignment(NamedTuple):
    score: float  # Smith-Waterman score as a share of the item's own
    run: int  # most words in a row
    edits: int  # words of the item replaced, left out or added where it fits best as a whole


def local_score(item: np.ndarray, doc: np.ndarray) -> int:
    """The best local alignment (Smith-Waterman: match 2, other -1), by rows of the table."""
    step = np.arange(len(doc) + 1)
    local, best = np.zeros(len(doc) + 1, np.int64), 0
    for w in item:
        x = np.zeros(len(doc) + 1, np.int64)
        x[1:] = np.maximum(np.maximum(local[:-1] + np.where(doc == w, 2, -1), local[1:] - 1), 0)
        local = np.maximum.accumulate(x + step) - step
        best = max(best, int(local.max()))
    return best


def align(item: np.ndarray, doc: np.ndarray, least: int = 0) -> Alignment | None:
    """The alignment of an item with a document, or None if its score is under `least`."""
    best = local_score(item, doc)
    if best < least:
        return None
    step = np.arange(len(doc) + 1)
    fit, run, longest = np.zeros(len(doc) + 1, np.int64), np.zeros(len(doc) + 1, np.int64), 0
    for w in item:
        same = doc == w
        y = fit + 1
        y[1:] = np.minimum(y[1:], fit[:-1] + ~same)
        fit = np.minimum.accumulate(y - step) + step
        z = np.zeros(len(doc) + 1, np.int64)
        z[1:] = np.where(same, run[:-1] + 1, 0)
        run = z
        longest = max(longest, int(run.max()))
    return Alignment(best / (2 * max(1, len(item))), longest, int(fit.min()))


def leak_of(doc_words: np.ndarray, it: Item, run: int, per: int, own: np.ndarray | None = None) -> tuple | None:
    """The columns of the result after the ids, if the document holds the item. `own` are the document's different grams of the item's length."""
    mine = np.unique(grams(it.hashes, it.q))
    own = np.unique(grams(doc_words, it.q)) if own is None else own
    if np.isin(mine, own, assume_unique=True).sum() < it.least:
        return None
    n = len(it.hashes)
    a = align(it.hashes, doc_words, needed_score(n, run, per))
    if a is None or not (a.run >= min(run, n) or a.edits <= n // per):
        return None
    return n, a.run, a.edits, a.score, "whole" if a.run == n else "edited" if a.edits <= n // per else "passage"


SCHEMA = "doc_id bigint, item_id bigint, item_words int, longest_run int, edits int, score double, kind string"


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _hashed(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (an id and t) with the words of t as 64-bit hashes in `w`; rows without a word are left out."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column(1))
            some = [(b.column(0)[k].as_py(), w.hashes[x:y].tobytes()) for k, (x, y) in enumerate(zip(w.ends[:-1], w.ends[1:], strict=True)) if y > x]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([h for _, h in some], pa.binary())], names=[name, "w"])

    return rows.mapInArrow(op, f"{name} bigint, w binary")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", run: int = RUN, gram: int = GRAM, words_per_replacement: int = WORDS_PER_REPLACEMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every (document, item) where the document holds the item whole, or `run` of its words in a row, or the whole item with at most one word in `words_per_replacement` edited.

    Result: doc_id, item_id, item_words, longest_run, edits (of the best fit of the whole item), score
    (Smith-Waterman, 1 for a whole copy) and kind (whole, edited or passage), once a pair. Items and
    documents without a word, null texts and null ids are left out; repeated rows count once; of two
    texts under one id the one that aligns better is reported; an empty table on either side gives an
    empty result. Item ids and document ids must be whole numbers.
    """
    spark, per = docs.sparkSession, words_per_replacement
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null").distinct()
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t")).where("d is not null and t is not null")
    queries = staged(_hashed(asked, "i").distinct(), "items")
    size = queries.agg(F.coalesce(F.sum(F.octet_length("w") / 8), F.lit(0))).first()[0]
    if not size:
        return spark.createDataFrame([], SCHEMA)
    if size <= block_words:
        found = _by_broadcast(rows, [make_item(r.i, np.frombuffer(r.w, np.uint64), run, gram, per) for r in queries.collect()], run, per)
    else:
        found = _by_join(rows, queries, run, gram, per)
    best = F.max(F.struct("score", "longest_run", -F.col("edits"), "item_words", "edits", "kind")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.item_words", "x.longest_run", "x.edits", "x.score", "x.kind")


def _by_broadcast(rows: DataFrame, block: list[Item], run: int, per: int) -> DataFrame:
    """The leaks, with items of a bounded number of words on every executor."""
    shared = rows.sparkSession.sparkContext.broadcast((block, seed_table(block)))

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seeds = shared.value
        for b in batches:
            w = words(b.column(1))
            near: dict[int, set[int]] = {}
            for q, (seed, owner) in seeds.items():
                g = grams(w.hashes, q)
                lo = np.searchsorted(seed, g)
                row = np.searchsorted(w.ends, np.arange(len(g)), side="right") - 1
                hit = np.flatnonzero((seed[np.minimum(lo, len(seed) - 1)] == g) & (np.arange(len(g)) + q <= w.ends[np.minimum(row + 1, len(w.ends) - 1)]))
                hi = np.searchsorted(seed, g[hit], side="right")
                for at, x, y in zip(row[hit].tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
                    near.setdefault(at, set()).update(owner[x:y].tolist())
            out = []
            for at, ks in near.items():
                mine = w.hashes[w.ends[at] : w.ends[at + 1]]
                own: dict[int, np.ndarray] = {}
                for k in sorted(ks):
                    it = block[k]
                    if it.q not in own:
                        own[it.q] = np.unique(grams(mine, it.q))
                    if x := leak_of(mine, it, run, per, own[it.q]):
                        out.append((b.column(0)[at].as_py(), it.item_id, *x))
            if out:
                yield _rows(out)

    return rows.mapInArrow(op, SCHEMA)


def _by_join(rows: DataFrame, queries: DataFrame, run: int, gram: int, per: int) -> DataFrame:
    """The leaks, with seeds and items as tables. A gram that stands in a third of all documents is a seed of last choice, and its join splits under adaptive skew handling."""
    keyed = queries.withColumn("k", F.md5("w"))

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                it = make_item(0, np.frombuffer(w, np.uint64), run, gram, per)
                g = np.unique(grams(it.hashes, it.q))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(g)), pa.array(np.full(len(g), it.q, np.int32)), pa.array(g.view(np.int64)), pa.array(np.full(len(g), max(1, len(g) - it.least + 1), np.int32))], names=["k", "q", "g", "seeds"])

    every = staged(keyed.select("k", "w").dropDuplicates(["k"]).mapInArrow(item_grams, "k string, q int, g bigint, seeds int"), "grams")
    lengths = sorted(r.q for r in every.select("q").distinct().collect())  # at most `gram` numbers
    times = every.groupBy("q", "g").agg(F.count("*").alias("times"))
    rare = F.row_number().over(Window.partitionBy("k").orderBy("times", "g"))
    seeds = every.join(times, ["q", "g"]).withColumn("r", rare).where("r <= seeds").select("q", "g", "k")

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column(1))
            for q in lengths:
                g = grams(w.hashes, q)
                row = np.searchsorted(w.ends, np.arange(len(g)), side="right") - 1
                inside = np.arange(len(g)) + q <= w.ends[np.minimum(row + 1, len(w.ends) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[inside])), pa.array(np.full(inside.sum(), q, np.int32)), pa.array(g[inside].view(np.int64))], names=["d", "q", "g"])

    pairs = staged(rows.mapInArrow(doc_grams, "d bigint, q int, g bigint").join(seeds, ["q", "g"]).select("d", "k").distinct(), "pairs")
    met = pairs.join(rows, "d").join(keyed, "k").select("d", "i", "t", "w")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column(2))
            out = []
            for at in range(b.num_rows):
                it = make_item(b.column(1)[at].as_py(), np.frombuffer(b.column(3)[at].as_py(), np.uint64), run, gram, per)
                if x := leak_of(w.hashes[w.ends[at] : w.ends[at + 1]], it, run, per):
                    out.append((b.column(0)[at].as_py(), it.item_id, *x))
            if out:
                yield _rows(out)

    return met.mapInArrow(op, SCHEMA)
