from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from lodeseek.llm.neighbours import SLACK, Search, Tree, _legs, chi_square_quantile, encode, most_similar, pairs_of

SCHEMA = "id bigint, embedding array<float>, rep string, key string, cosine string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "r", "k", "c") for i, v in vectors], SCHEMA)


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s.round(6), axis=1, kind="stable")[:, :k]
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in top[i] if s[i, j] >= least}


def clustered(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for k in range(0, n, 5):  # every fifth has a close relative at cosines from 0.9 on
        x[(k + 1) % n] = x[k] / np.linalg.norm(x[k]) + rng.standard_normal(dims) / dims**0.5 * rng.uniform(0.05, 0.45)
    return x


@pytest.mark.parametrize(("least", "recall"), [(0.9, 0.97), (None, 0.9)])
def test_recall(spark, least, recall):
    x = clustered(3000, 32)
    got = {(r.id, r.neighbour) for r in most_similar(frame(spark, list(enumerate(x))), 5, least, leaf=128).collect()}
    want = brute(list(range(len(x))), x, 5, least if least is not None else -2)
    assert len(got & want) >= recall * len(want)
    if least:
        assert got <= brute(list(range(len(x))), x, 50, least)


def test_recall_holds_in_deep_trees(spark):
    x = np.random.default_rng(4).standard_normal((3000, 64))
    got = {(r.id, r.neighbour) for r in most_similar(frame(spark, list(enumerate(x))), 5, leaf=12).collect()}
    want = brute(list(range(len(x))), x, 5, -2)
    assert len(got & want) >= 0.98 * len(want)


def test_skipped_leaves_add_up_to_the_tail():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    t, u = Tree(x, 6000, 24), rng.standard_normal((6000, 24))
    u -= (u * x).sum(axis=1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    for cosine in (0.3, 0.7, 0.95):
        q, to, _ = t.likely(t.project(x), np.full(6000, cosine), 0.05)
        for c in (cosine, (3 + cosine) / 4):
            at = t.leaf_of(t.project((c * x + (1 - c * c) ** 0.5 * u).astype(np.float32)))
            assert np.isin(np.arange(6000) * 256 + at, q * 256 + to).mean() >= 0.95
    assert len(t.cuts) == 8 and len(t.likely(t.project(x), np.zeros(6000), 0.05)[0]) == 6000 * 256


def test_edges(spark):
    z = [0.0, 0.0, 0.0]
    rows = [(1, [1, 0, 0]), (1, [1, 0, 0]), (2, [2, 0, 0]), (3, [0.9, 0.1, 0]), (4, z), (5, None), (6, [1, None, 0]), (7, [float("inf"), 0, 0]), (None, [1, 0, 0]), (8, []), (9, [0, 0, 5]), (10, [3])]
    got = {(r.id, r.neighbour): r.cosine for r in most_similar(frame(spark, rows), 5, 0.9).collect()}
    assert {i for p in got for i in p} == {1, 2, 3, 10}
    assert got[1, 2] == pytest.approx(1) and got[1, 3] == pytest.approx(0.9 / (0.82**0.5)) and (10, 1) in got
    assert most_similar(frame(spark, []), 5, 0.9).count() == 0
    assert most_similar(frame(spark, [(1, z)]), 5, 0.9).count() == 0


def test_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(500, [1.0, 2.0, 3.1])]
    got = most_similar(frame(spark, rows), 5, 0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.place, r.neighbour))
    assert [n for _, n in sorted(by[100])] == [0, 1, 2, 3, 4] and [n for _, n in sorted(by[0])] == [1, 2, 3, 4, 5]
    assert [n for _, n in sorted(by[500])] == [0, 1, 2, 3, 4]
    assert len(by) == 201
    assert pairs_of(most_similar(frame(spark, rows), 5, 0.9), 0.9).count() == 194 * 5 + 15 + 5


def test_dense_cluster_is_found_without_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((600, 16)), np.ones((400, 16)) + rng.standard_normal((400, 16)) * 0.05])
    got = most_similar(frame(spark, list(enumerate(x))), 5, 0.9, leaf=64).collect()
    mine = {(r.id, r.neighbour) for r in got if r.id >= 600}
    want = {p for p in brute(list(range(1000)), x, 5, 0.9) if p[0] >= 600}
    assert len(mine & want) >= 0.9 * len(want) and len(mine) <= 2000


def test_a_group_that_is_too_large_is_split(spark):
    """A tree fitted on a few vectors cuts badly; groups far above plan are dealt over several tasks and nothing is lost."""
    x = np.concatenate([np.random.default_rng(1).standard_normal((300, 16)), np.ones((1500, 16)) + np.random.default_rng(2).standard_normal((1500, 16)) * 0.3])
    got = {(r.id, r.neighbour) for r in most_similar(frame(spark, list(enumerate(x))), 5, 0.9, leaf=16, sample=30).collect()}
    want = brute(list(range(len(x))), x, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want)


def test_tree():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 20)).astype(np.float32)
    t = Tree(x[:1000], 4000, 250, axes=3)
    p = t.project(x)
    leaf = t.leaf_of(p)
    assert np.bincount(leaf).max() < 2 * 250 and len(t.cuts) == 4 and p.shape[1] == 3
    lo, hi = t.boxes(leaf)
    assert ((p >= lo) & (p <= hi)).all()
    q, to, floor = t.likely(p, np.full(len(p), 0.9), 0.05)
    every = t.chances(p, np.full(len(p), 0.9), np.arange(16))
    assert set(zip(range(4000), leaf, strict=True)) <= set(zip(q, to, strict=True)) and len(q) < 4000 * 12
    assert (every[q, to] >= floor[q] - 1e-5).all() and every.sum(axis=1).min() > 0.99


def test_a_group_looks_only_at_leaves_that_hold_something(spark, monkeypatch):
    """In a group, chances are not worked out for each query and each leaf: at 5.6 million vectors these were most of the CPU time."""
    steps, cells, kept = [], [], Tree.chances
    ops = PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: steps.append(f) or ops(self, f, schema))
    x = clustered(3000, 32)
    most_similar(frame(spark, list(enumerate(x[:50]))), 5, 0.9, leaf=1)  # the step depends on the tree alone
    home = steps[0]
    t = dict(zip(home.__code__.co_freevars, home.__closure__, strict=True))["tree"].cell_contents.value
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    code, scale = encode(u)
    leaf = t.leaf_of(t.project(code * scale[:, None]))
    table = pa.table({"rep": np.arange(3000), "leaf": leaf.astype(np.int32), "code": [c.tobytes() for c in code], "scale": scale, "first": np.ones(3000, bool)})
    group = leaf >> t.group_bits == 0
    monkeypatch.setattr(Tree, "chances", lambda self, p, c, leaves: cells.append(len(p) * len(leaves)) or kept(self, p, c, leaves))
    out = home(table, table.filter(pa.array(group))).to_pylist()
    got = {(r["rep"], n["b"]) for r in out for n in r["near"] if n["sim"] >= 0.9}
    assert got <= brute(list(range(3000)), x, 50, 0.9) and got
    assert sum(cells) < 3000 * len(np.unique(leaf[group])) / 4


def test_legs():
    who, to = np.array([0, 0, 0, 2, 2]), np.array([1, 15, 16, 3, 40])
    q, group, marks = _legs(who, to, 4)
    assert q.tolist() == [0, 0, 2, 2] and group.tolist() == [0, 1, 0, 2]
    at = np.unpackbits(marks, axis=1, count=16, bitorder="little")
    assert [np.flatnonzero(r).tolist() for r in at] == [[1, 15], [0], [3], [8]]
    assert [len(v) for v in _legs(who[:0], to[:0], 0)] == [0, 0, 0] and _legs(who, to, 0)[2].tolist() == [[1]] * 5


def test_chi_square_test_and_codes():
    assert chi_square_quantile(16, 0.001) == pytest.approx(39.25, abs=0.3) and chi_square_quantile(8, 0.05) == pytest.approx(15.51, abs=0.1)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    code, scale = encode(x)
    y = code * scale[:, None]
    assert np.abs(x @ x.T - y @ y.T).max() < SLACK
    near = x + rng.standard_normal(x.shape).astype(np.float32) * 0.02
    near /= np.linalg.norm(near, axis=1)[:, None]
    t = Tree(x, 500, 1024)
    for least in (0.9, 0.1):  # by projected distance, and all at once
        s = Search(np.arange(500), x, t.project(x), np.full(500, least, np.float32), 3)
        s.visit(np.arange(500), np.arange(500) + 1000, near, t.project(near))
        q, b, _ = s.edges()
        assert len(set(zip(q, b, strict=True)) & {(i, i + 1000) for i in range(500)}) >= 498
        assert (s.bound >= least).all()
