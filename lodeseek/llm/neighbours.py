"""The most similar vectors for every vector (problem 5).

Unit vectors get M coordinates by 2-stable (Gaussian, orthonormalised) projections. A kd-tree over the
coordinates, cut at medians of a bounded sample, has leaves of about a thousand vectors; neighbouring
leaves form groups, which are what tasks work on. The search of a vector is incremental:

1. In its own group it visits its own leaf, then the group's other leaves, each time with the bound
   that its k-th best so far sets (or `min_cosine`, if that is higher).
2. It then goes to the other groups that may hold something better, and to their leaves likewise.

Two tests stop it. A leaf is left out once the leaves left out together hold a neighbour as near as
the bound with a chance of at most `tail`, at any depth: where a vector has the coordinates p, those of
a unit vector at cosine c to it are normal around c*p with variance 1 - c*c, axis by axis. In a visited
leaf, vectors are verified in order of their projected distance until a chi-square test holds: a
squared distance of d shows in M coordinates as d times a chi-square variable with M degrees of
freedom, so beyond d times its quantile nothing as near as the bound is left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.session import spread, staged

LEAF, SAMPLE, TAIL, AXES = 1024, 20_000, 0.05, 16
# Chance that the chi-square test stops before a vector as near as the bound.
POINT_TAIL = 0.001
# Codes have one byte a number, which moves a cosine by less than this; whatever is that close is verified on full vectors.
SLACK = 0.008
# A group has at most so many vectors by plan, and an index at least so many groups, so that there are tasks for all.
GROUP, LEAST_GROUPS = 1 << 17, 8
_NEARER = (1.0, 1 / 4)  # squared distances, as shares of the bound's, at which leaves must be held
_ROUTES = 1 << 19  # chances held at a time; each takes some 150 bytes while leaves are chosen
_BLOCK = 1 << 14  # queries that visit leaves together at most
_LEAST = (24, 4, 1)  # least chances that are looked at, in units of what loses an eighth of the tail at most
_AT = np.linspace(-8, 8, 16_001)
_CDF = np.array([math.erfc(-z / math.sqrt(2)) / 2 for z in _AT])
_CODE = "rep bigint, leaf int, code binary, scale float"


def chi_square_quantile(degrees: int, tail: float) -> float:
    """The value that a chi-square variable exceeds with chance `tail` (Wilson and Hilferty)."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(1 - tail) * math.sqrt(a)) ** 3


class Tree:
    """A kd-tree over projections: level l cuts axis l modulo their number, each node at its own median of the sample.

    Dimension and number of leaves are chosen apart: there are `axes` projections (as many as the
    vectors have numbers, if those are fewer) and one leaf for each `leaf` of `rows`, at most
    2^max_depth; beyond that leaves grow, and groups are split into more tasks.
    """

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, axes: int = AXES, seed: int = 11, max_depth: int = 20) -> None:
        self.depth = 0 if rows <= leaf else min(max_depth, max(1, round(math.log2(rows / leaf))))
        dims = sample.shape[1]
        m = min(axes, dims)
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, m)))
        self.axes = (q * math.sqrt(dims)).astype(np.float32)
        plan = min(GROUP, max(1, rows // LEAST_GROUPS))
        self.group_bits = min(self.depth, max(0, int(math.log2(max(1, plan / leaf)))))
        self.cuts: list[np.ndarray] = []
        p = self.project(sample)
        node = np.zeros(len(sample), np.int64)
        for level in range(self.depth):
            own = p[:, level % m]
            cut = np.full(1 << level, float(np.median(own)) if len(own) else 0.0, np.float32)
            order = np.argsort(node, kind="stable")
            begin = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k in np.flatnonzero(np.diff(begin) >= 16):  # under that, the median of the whole sample is the better guess
                cut[k] = np.median(own[order[begin[k] : begin[k + 1]]])
            self.cuts.append(cut)
            node = node * 2 + (own > cut[node])

    @property
    def groups(self) -> int:
        return 1 << (self.depth - self.group_bits)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for level, cut in enumerate(self.cuts):
            node = node * 2 + (p[:, level % p.shape[1]] > cut[node])
        return node

    def boxes(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest coordinate of each leaf on each axis."""
        m = self.axes.shape[1]
        lo, hi = np.full((len(leaves), m), -np.inf), np.full((len(leaves), m), np.inf)
        for level, cut in enumerate(self.cuts):
            c, a = cut[leaves >> (self.depth - level)], level % m
            up = (leaves >> (self.depth - level - 1)) & 1 == 1
            lo[:, a] = np.where(up, np.maximum(lo[:, a], c), lo[:, a])
            hi[:, a] = np.where(up, hi[:, a], np.minimum(hi[:, a], c))
        return lo, hi

    def chances(self, p: np.ndarray, cosine: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """(query, leaf): the largest chance, over the distances in _NEARER, that the leaf holds a neighbour at that distance; 1 where the cosine isn't above 0."""
        lo, hi = self.boxes(leaves)
        best = np.zeros((len(p), len(leaves)), np.float32)
        for share in _NEARER:
            c = np.clip(1 - (1 - np.clip(cosine, 0, 1)) * share, 0, 1)
            width = np.sqrt(np.maximum(1e-9, 1 - c * c))
            out = np.ones((len(p), len(leaves)), np.float32)
            for a in range(p.shape[1]):
                bounded = np.isfinite(lo[:, a]) | np.isfinite(hi[:, a])
                if bounded.any():
                    mid = (c * p[:, a])[:, None]
                    z = lambda edge: np.interp((edge[None, bounded] - mid) / width[:, None], _AT, _CDF, left=0, right=1)
                    out[:, bounded] *= (z(hi[:, a]) - z(lo[:, a])).astype(np.float32)
            best = np.maximum(best, out)
        best[cosine <= 0] = 1
        return best

    def likely(self, p: np.ndarray, cosine: np.ndarray, tail: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf) of the leaves to visit, by query and leaf, and for each query the smallest chance among them.

        Likeliest leaves come first, until those left out hold less than `tail` in all, at each of the
        distances in _NEARER. Every leaf for queries whose cosine isn't above 0.
        """
        floor, deep = np.full(len(p), np.inf), self.depth
        every = np.flatnonzero(cosine <= 0)
        floor[every] = 0
        found = [(every[:, None] << deep | np.arange(1 << deep)).ravel()]
        for share in _NEARER:
            c = 1 - (1 - np.clip(cosine, 0, 1)) * share
            rest = np.flatnonzero(cosine > 0)
            # What is under the least chance is not looked at. Where what is over it holds too little, the least is lowered.
            for least in (tail * x / (8 << deep) for x in _LEAST):
                q, node, chance = self.descend(p[rest], c[rest], least)
                order = np.lexsort((-chance, q))
                q, node, chance = q[order], node[order], chance[order]
                before = np.cumsum(chance) - chance
                first = np.searchsorted(q, np.arange(len(rest)))
                before -= before[np.minimum(first, len(before) - 1)][q]
                enough = (np.bincount(q, chance, len(rest)) >= 1 - tail * 7 / 8) | (least == tail / (8 << deep))
                keep = (before < 1 - tail * 7 / 8) & enough[q]
                found.append(rest[q[keep]] << deep | node[keep])
                np.minimum.at(floor, rest[q[keep]], chance[keep])
                rest = rest[~enough]
                if not len(rest):
                    break
        both = np.unique(np.concatenate(found))
        return both >> deep, both & ((1 << deep) - 1), floor

    def descend(self, p: np.ndarray, cosine: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, chance) of the leaves that hold a neighbour at that cosine with a chance of at least `least`."""
        width = 1 / np.sqrt(np.maximum(1e-9, 1 - cosine * cosine))
        mid = np.ascontiguousarray(((cosine * width)[:, None] * p).T)
        q, node, chance = np.arange(len(p)), np.zeros(len(p), np.int64), np.ones(len(p))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the axes that are cut again
        for level, cut in enumerate(self.cuts):
            a = level % len(mid)
            z = _below(cut[node] * width[q] - mid[a][q])
            if a in bounds:
                low, high = bounds.pop(a)
                z = np.clip(z, low, high)
                part = chance / np.maximum(high - low, 1e-300)
                lower, upper = part * (z - low), part * (high - z)
            else:
                low, high = np.zeros(len(q)), np.ones(len(q))
                lower, upper = chance * z, chance * (1 - z)
            k0, k1 = np.flatnonzero(lower >= least), np.flatnonzero(upper >= least)
            both = np.concatenate([k0, k1])
            bounds = {axis: (l[both], h[both]) for axis, (l, h) in bounds.items()}
            if level + len(mid) < self.depth:
                bounds[a] = np.concatenate([low[k0], z[k1]]), np.concatenate([z[k0], high[k1]])
            q, node, chance = q[both], node[both] * 2, np.concatenate([lower[k0], upper[k1]])
            node[len(k0) :] += 1
        return q, node, chance

    def routes(self, p: np.ndarray, cosine: np.ndarray, tail: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """`likely` for many queries, block by block: the block's queries, then (query's place in the block, leaf) and floors. What is held at a time is bounded by _ROUTES."""
        a = begin = held = 0
        step = least = max(1, _ROUTES >> self.depth)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while a < len(p):
            q, to, floor = self.likely(p[a : a + step], cosine[a : a + step], tail)
            parts.append((q + (a - begin), to, floor))
            a, held = a + len(floor), held + len(q)
            # A query looks at some four times the leaves that it keeps.
            step = max(least, min(2 * step, _ROUTES * len(floor) // (4 * max(1, len(q)))))
            if a >= len(p) or held >= 2 * _ROUTES or a - begin >= _BLOCK:
                who, to, floor = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield np.arange(begin, a), who, to, floor
                begin, held, parts = a, 0, []


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, by its table."""
    at = np.clip((z + 8) * 1000, 0, 15_999.999)
    i = at.astype(np.int32)
    low = _CDF[i]
    return low + (at - i) * (_CDF[i + 1] - low)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors with one byte a number, and each vector's scale."""
    top = np.maximum(np.abs(x).max(axis=1), 1e-30)
    return np.round(x * (127 / top)[:, None]).astype(np.int8), (top / 127).astype(np.float32)


def _blobs(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int64) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _matrix(blobs: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    a = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.binary())
    if not len(a):
        return np.zeros((0, 1), kind)
    _, places, data = a.buffers()
    at = np.frombuffer(places, np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(a), -1)


def _marked(z: np.ndarray) -> np.ndarray:
    """Flat places of what holds, for few in many; the number of columns is a multiple of 8."""
    words = np.flatnonzero(z.ravel().view(np.uint64))
    at, place = np.nonzero(z.reshape(-1, 8)[words])
    return words[at] * 8 + place


class Search:
    """The best so far of some queries, against one leaf after another."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.ids, self.x, self.p, self.k = ids, x, p, k
        self.norm = (p * p).sum(axis=1)
        self.least = bound
        self.best = np.full((len(ids), k), -2.0, np.float32)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.quantile = chi_square_quantile(p.shape[1], POINT_TAIL)

    @property
    def bound(self) -> np.ndarray:
        """What a neighbour must reach to count."""
        return np.maximum(self.least, self.best[:, -1])

    def visit(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray, p: np.ndarray, block: int = 256) -> None:
        """Compare the queries `who` with the vectors of one leaf."""
        # One product gives how far each squared distance lies beyond what the test allows; columns are filled up to eights.
        right = np.zeros((p.shape[1] + 2, -(-len(p) // 8) * 8), p.dtype)
        right[-1] = np.inf
        right[:-2, : len(p)], right[-2], right[-1, : len(p)] = p.T * -2, 1, (p * p).sum(axis=1)
        for a in range(0, len(who), block):
            w = who[a : a + block]
            bound = np.maximum(self.least[w], self.best[w, -1]) - SLACK
            if np.median(bound) > 0.75:  # few pass the test: it costs M products a pair, and verification is rare
                allowed = (2 - 2 * bound) * self.quantile
                left = np.column_stack([self.p[w], self.norm[w] - allowed, np.ones(len(w), p.dtype)]).astype(p.dtype, copy=False)
                i, j = np.divmod(_marked(left @ right <= 0), right.shape[1])
                s = np.einsum("ij,ij->i", self.x[w[i]], x[j])
                ok = (s >= bound[i]) & (self.ids[w[i]] != ids[j])
                i, j, s = i[ok], j[ok], s[ok]
            else:  # nearly all would pass: one product verifies all
                every = self.x[w] @ x.T
                every[self.ids[w][:, None] == ids[None, :]] = -2
                if len(ids) > self.k:
                    bound = np.maximum(bound, np.partition(every, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - SLACK)
                i, j = np.nonzero(every >= bound[:, None])
                s = every[i, j]
            if not len(i):
                continue
            self.found.append((w[i], ids[j], s.astype(np.float32)))
            order = np.lexsort((-s, i))
            i, s = i[order], s[order]
            at = np.arange(len(i)) - np.searchsorted(i, i)
            top = at < self.k
            fresh = np.full((len(w), self.k), -2.0, np.float32)
            fresh[i[top], at[top]] = s[top]
            self.best[w] = -np.sort(-np.concatenate([self.best[w], fresh], axis=1), axis=1)[:, : self.k]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, similarity) of all that may still be among the k best."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        q, b, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = s >= self.bound[q] - SLACK
        return q[keep], b[keep], s[keep]


def unit_vectors(records: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """id and vec (float32 bytes of length 1), and how many numbers each has. Null vectors, null ids, vectors of zero and vectors with a null or a number that is not finite are left out; short ones are filled up with zeros."""
    rows = records.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, size = np.asarray(b.column(1).flatten(), dtype=np.float64), np.asarray(b.column(1).value_lengths())
            if (size == dims).all():
                x = flat.reshape(-1, dims)
            else:
                x = np.zeros((len(size), dims))
                x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            big = np.abs(x).max(axis=1)
            keep = np.isfinite(big) & (big > 0)
            x = x[keep] / big[keep, None]
            x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), _blobs(x)], names=["id", "vec"])

    return rows.mapInArrow(op, "id bigint, vec binary"), dims


def _cells(rows: DataFrame, by: str, sizes: DataFrame, other: str) -> DataFrame:
    """`rows` with their cell: a group's rows are dealt over the parts of their own side and repeated for each part of the other side."""
    own, copy = F.pmod(F.xxhash64("rep"), F.col(by)).cast("int"), F.col("copy")
    part, ask = (own, copy) if by == "parts" else (copy, own)
    spread_out = rows.join(sizes, "group").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    return spread_out.withColumn("cell", F.struct("group", part.alias("part"), ask.alias("ask"))).drop("parts", "asked", "copy", "group")


def most_similar(records: DataFrame, k: int = 5, min_cosine: float | None = None, id: str = "id", vector: str = "embedding", leaf: int = LEAF, sample: int = SAMPLE, tail: float = TAIL, axes: int = AXES, seed: int = 11, max_depth: int = 20) -> DataFrame:
    """For each vector the k others with the largest cosine; with `min_cosine`, only those that reach it.

    Result: id, neighbour, cosine (of the full vectors), place (1 to k). Equal cosines are ordered by
    the neighbour's id. `min_cosine` is also the farthest the search looks, which makes it cheap; without
    it the k-th neighbour found so far is the bound. Vectors of zero, nulls and vectors with a null or
    infinite number have no neighbours and are nobody's. Lengths of vectors don't matter. Ids must be
    whole numbers; rows with one id count once. An empty table gives an empty result.

    Equal vectors are collapsed first: k+1 of them stand for all, as no more can be among anybody's k
    best, so a third of all rows with one vector costs no more than a few. The tree is fitted on about
    `sample` vectors; every vector is indexed. A neighbour is missed with a chance of about `tail` at
    most, whatever the number of rows, and less where the neighbour finds the vector in turn. Cuts follow
    the sample's density, so a tight cluster has leaves of its own; a group that still becomes too
    large is dealt over several tasks, on the side of the vectors and on that of the queries.
    """
    spark = records.sparkSession
    schema = "id bigint, neighbour bigint, cosine double, place int"
    unit, dims = unit_vectors(records, id, vector)
    n = records.count()
    share = min(1.0, sample / max(n, 1))
    chosen = records.where(F.pmod(F.xxhash64(F.col(f"`{id}`").cast("long"), F.lit(seed)), F.lit(1 << 24)) < int(share * (1 << 24)))
    some = unit_vectors(chosen, id, vector)[0].limit(2 * sample).toPandas()["vec"]
    fitted = np.stack([np.frombuffer(v, np.float32) for v in some]) if len(some) else np.zeros((0, dims), np.float32)
    if len(fitted) and fitted.shape[1] < dims:
        fitted = np.pad(fitted, ((0, 0), (0, dims - fitted.shape[1])))
    fit = Tree(fitted, n, leaf, axes, seed, max_depth)
    tree, least = spark.sparkContext.broadcast(fit), -1.0 if min_cosine is None else min_cosine
    bits, group = fit.group_bits, lambda c: F.shiftright(c, fit.group_bits).alias("group")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), np.float32)
                code, scale = encode(x)
                at = tree.value.leaf_of(tree.value.project(code * scale[:, None]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), _blobs(code), pa.array(scale)], names=["id", "vec", "leaf", "code", "scale"])

    base = staged(unit.mapInArrow(place, "id bigint, vec binary, leaf int, code binary, scale float").withColumn("key", F.md5("vec")), "vectors")
    ids = base.select("key", "id").distinct()
    placed = staged(base.groupBy("key").agg(F.min("id").alias("rep"), F.first("leaf").alias("leaf"), F.first("code").alias("code"), F.first("scale").alias("scale")).select("key", "rep", "leaf", "code", "scale"), "placed")
    # Parts of a group's vectors, and of the queries that come to it: mostly one of each.
    plan = max(leaf << bits, 1)
    sized = staged(placed.groupBy(group(F.col("leaf"))).agg(F.ceil(F.count("*") / (2 * plan)).cast("int").alias("parts"), F.ceil(F.count("*") / (4 * plan)).cast("int").alias("asked")), "groups")

    def prepared(table: pa.Table, points: pa.Table, bound: np.ndarray) -> tuple[Search, Callable[[np.ndarray, np.ndarray, np.ndarray], None], Callable[[np.ndarray], None]]:
        """The search of the queries of `table` in one group, with its two steps: own leaves, and others."""
        t = tree.value
        x, y = _decoded(table), _decoded(points)
        py, other, where = t.project(y), np.asarray(points["rep"]), np.asarray(points["leaf"])
        order = np.argsort(where, kind="stable")
        leaves, begin = np.unique(where[order], return_index=True)
        end = np.append(begin[1:], len(order))
        s = Search(np.asarray(table["rep"]), x, t.project(x), bound, k)

        def visit(who: np.ndarray, at: int) -> None:
            rows = order[begin[at] : end[at]]
            s.visit(who, other[rows], y[rows], py[rows])

        def own(home: np.ndarray) -> None:
            by = np.argsort(home, kind="stable")
            for at, (a, b) in enumerate(zip(np.searchsorted(home[by], leaves), np.searchsorted(home[by], leaves, "right"), strict=True)):
                if b > a:
                    visit(by[a:b], at)

        def others(rows: np.ndarray, wants: np.ndarray, floor: np.ndarray) -> None:
            """Visit what `wants` (leaf of the group, query of `rows`) marks."""
            # The likeliest leaves of the group first; what they find tightens the test for the rest.
            some = rows[:: max(1, len(rows) // 128)]
            for at in np.argsort(-t.chances(s.p[some], s.bound[some] - SLACK, leaves).sum(axis=0)):
                place = np.flatnonzero(wants[leaves[at] & ((1 << bits) - 1)])
                who = rows[place]
                tight = s.best[who, -1] > s.least[who]
                if tight.any():
                    again = t.chances(s.p[who[tight]], s.bound[who[tight]] - SLACK, leaves[at : at + 1])[:, 0]
                    tight[tight] = again < floor[place[tight]]
                    who = who[~tight]
                if len(who):
                    visit(who, at)

        return s, others, own

    def home(left: pa.Table, right: pa.Table) -> pa.Table:
        t = tree.value
        if not left.num_rows or not right.num_rows:
            return _homed([], np.zeros((0, 1), np.int8), [], [], [], [], [], [], [])
        at = np.asarray(left["leaf"])
        s, others, own = prepared(left, right, np.full(left.num_rows, least, np.float32))
        own(at)
        # Where a group has several parts, a query goes on to other groups from the first one only.
        first, floors = np.asarray(left["first"]), np.zeros(left.num_rows)
        whose, groups, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, _width(bits)), np.uint8)]
        before = s.bound.copy()
        for rows, who, to, floor in t.routes(s.p, before - SLACK, tail):
            wants = np.zeros((1 << bits, len(rows)), bool)
            here = (to >> bits == at[rows][who] >> bits) & (to != at[rows][who])
            wants[to[here] & ((1 << bits) - 1), who[here]] = True
            others(rows, wants, floor)
            floors[rows] = floor
            changed = (s.bound[rows] > before[rows]) & first[rows]
            go = first[rows][who] & ~changed[who]
            legs = [(rows[who[go]], to[go])]
            for some, q, leaf_to, low in t.routes(s.p[rows[changed]], s.bound[rows[changed]] - SLACK, tail):
                floors[rows[changed][some]] = low
                legs.append((rows[changed][some][q], leaf_to))
            for q, leaf_to in legs:
                abroad = leaf_to >> bits != at[q] >> bits
                for kept, new in zip((whose, groups, masks), _legs(q[abroad], leaf_to[abroad], bits), strict=True):
                    kept.append(new)
        q, b, sim = s.edges()
        order = np.argsort(q, kind="stable")
        return _homed(s.ids, _matrix(left["code"], np.int8), np.asarray(left["scale"]), s.bound, floors, *(np.concatenate(v) for v in (whose, groups, masks)), q[order], b[order], sim[order])

    def away(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=["a", "b", "sim"])
        s, others, _ = prepared(left, right, np.asarray(left["bound"], dtype=np.float32))
        floor, masks = np.asarray(left["floor"], dtype=np.float64), _matrix(left["leaves"], np.uint8)
        for a in range(0, left.num_rows, step := max(1, (16 * _ROUTES) >> bits)):
            rows = np.arange(a, min(a + step, left.num_rows))
            others(rows, np.unpackbits(np.ascontiguousarray(masks[rows].T), axis=0, count=1 << bits, bitorder="little"), floor[rows])
        q, b, sim = s.edges()
        return pa.table([pa.array(s.ids[q]), pa.array(b), pa.array(sim)], names=["a", "b", "sim"])

    points = placed.select("rep", "leaf", "code", "scale", group(F.col("leaf")))
    points = points.toDF(*points.columns)
    parts = max(spread(spark), 2 * fit.groups)
    side = lambda rows, by, sizes: _cells(rows, by, sizes, "asked" if by == "parts" else "parts").repartition(parts, "cell").groupBy("cell")
    # `first` holds for the copy of a query that meets the first part of its group.
    asked = _cells(placed.select("rep", "leaf", "code", "scale", group(F.col("leaf"))), "asked", sized, "parts").withColumn("first", F.expr("cell.part = 0"))
    homed = staged(asked.repartition(parts, "cell").groupBy("cell").cogroup(side(points, "parts", sized)).applyInArrow(home, _HOMED), "homed")
    queries = homed.select("rep", "code", "scale", "bound", "floor", F.explode("groups").alias("g")).select("rep", "code", "scale", "bound", "floor", "g.group", "g.leaves")
    load = queries.groupBy("group").agg(F.ceil(F.count("*") / (4 * plan)).cast("int").alias("asked"))
    loads = staged(sized.select("group", "parts").join(load, "group"), "loads")
    far = side(queries, "asked", loads).cogroup(side(points, "parts", loads)).applyInArrow(away, "a bigint, b bigint, sim float")
    edges = homed.select(F.col("rep").alias("a"), F.explode("near").alias("x")).select("a", "x.b", "x.sim").unionAll(far)
    both = staged(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim")), "edges")
    # The k best of each vector set its bound; rows beyond k leave before the shuffle, so a vector that is everybody's neighbour is no hot key.
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim")))).where(F.col("r") <= k)
    kth = top.groupBy("a").agg(F.when(F.count("*") == k, F.min("sim")).otherwise(F.lit(-2.0)).alias("kth"))
    near = both.join(kth, "a").where(F.col("sim") >= F.col("kth") - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _rank(_verified(near, base, least), ids, placed.select("key", "rep"), k).select(*(x.split()[0] for x in schema.split(", ")))


_HOMED = "rep bigint, code binary, scale float, bound float, floor double, groups array<struct<group: int, leaves: binary>>, near array<struct<b: bigint, sim: float>>"


def _width(bits: int) -> int:
    """Bytes of a mark for each leaf of a group."""
    return max(1, (1 << bits) >> 3)


def _legs(who: np.ndarray, to: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query and group once, and the leaves it goes to there, a bit for each; (who, to) come ordered."""
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (to[1:] >> bits != to[:-1] >> bits)
    leaf, width = to & ((1 << bits) - 1), _width(bits)
    place = (np.cumsum(fresh) - 1) * width + (leaf >> 3)
    masks = np.zeros(int(fresh.sum()) * width, np.uint8)
    if len(place):
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        masks[place[at]] = np.bitwise_or.reduceat(np.left_shift(1, leaf & 7).astype(np.uint8), at)
    return who[fresh], to[fresh] >> bits, masks.reshape(-1, width)


def _decoded(table: pa.Table) -> np.ndarray:
    x = _matrix(table["code"], np.int8).astype(np.float32)
    x *= np.asarray(table["scale"], dtype=np.float32)[:, None]
    return x


def _homed(ids, code, scale, bound, floors, whose, groups, masks, q, b=(), sim=()) -> pa.Table:  # noqa: ANN001
    """Queries after their own group: what they found there (ordered by query) and the groups they go on to."""
    order = np.argsort(whose, kind="stable")
    cut = lambda by: pa.array(np.searchsorted(by, np.arange(len(ids) + 1)).astype(np.int32))
    legs = pa.StructArray.from_arrays([pa.array(np.asarray(groups)[order].astype(np.int32)), _blobs(np.asarray(masks, np.uint8).reshape(len(order), -1 if len(order) else 1)[order])], names=["group", "leaves"])
    near = pa.StructArray.from_arrays([pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(sim, np.float32))], names=["b", "sim"])
    return pa.table(
        [pa.array(np.asarray(ids, np.int64)), _blobs(code), pa.array(np.asarray(scale, np.float32)), pa.array(np.asarray(bound, np.float32)), pa.array(np.asarray(floors, float)), pa.ListArray.from_arrays(cut(np.asarray(whose)[order]), legs), pa.ListArray.from_arrays(cut(np.asarray(q)), near)],
        names=["rep", "code", "scale", "bound", "floor", "groups", "near"],
    )


def _verified(pairs: DataFrame, base: DataFrame, least: float) -> DataFrame:
    """a, b and the cosine of their full vectors, where it reaches `least`."""
    va, vb = base.select(F.col("id").alias("a"), F.col("vec").alias("va")), base.select(F.col("id").alias("b"), F.col("vec").alias("vb"))

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                l, r = (_matrix(x.column(c), np.float32).astype(np.float64) for c in ("va", "vb"))
                cos = (l * r).sum(axis=1) / np.sqrt((l * l).sum(axis=1) * (r * r).sum(axis=1))
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(np.clip(cos, -1, 1))], names=["a", "b", "cosine"])

    joined = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(dot, "a bigint, b bigint, cosine double").where(F.col("cosine") >= least).dropDuplicates(["a", "b"])


def _rank(pairs: DataFrame, ids: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Pairs of representatives as ranked neighbours of ids. The first k+1 ids of a group stand for it; the rest have the k first ones as their neighbours."""
    place = Window.partitionBy("key").orderBy("id")
    heads = ids.withColumn("p", F.row_number().over(place)).where(F.col("p") <= k + 1)
    of = heads.join(reps.select("key", "rep"), "key")
    directed = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    outer = directed.join(of.select(F.col("rep").alias("a"), "id"), "a").join(of.select(F.col("rep").alias("b"), F.col("id").alias("neighbour")), "b").select("id", "neighbour", "cosine")
    few = heads.select("key", F.col("id").alias("neighbour"))
    shared = few.groupBy("key").count().where("count > 1").select("key")
    inner = ids.join(shared, "key", "left_semi").join(few, "key").where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    ranked = outer.unionAll(inner).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("place") <= k)


def pairs_of(neighbours: DataFrame, min_cosine: float) -> DataFrame:
    """id_a < id_b, once for each pair of which one is a neighbour of the other with at least that cosine."""
    return neighbours.where(F.col("cosine") >= min_cosine).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
