from __future__ import annotations

import numpy as np
import pytest

from lodeseek.llm.ranking import loadings, oriented, principal_component, rank_together


def test_component():
    assert principal_component(np.array([[1, 0.4], [0.4, 1]])) == pytest.approx([0.5**0.5] * 2)
    assert sorted(principal_component(np.array([[1, -0.4], [-0.4, 1]]))) == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert principal_component(np.eye(3)) == pytest.approx([3**-0.5] * 3)
    assert principal_component(np.zeros((2, 2))) == pytest.approx([0.5**0.5] * 2)
    w = principal_component(np.array([[1, 0.9, 0.1], [0.9, 1, 0.1], [0.1, 0.1, 1]]))
    assert w[0] == pytest.approx(w[1]) and w[2] < w[0] and np.linalg.norm(w) == pytest.approx(1)
    # Two scores agree and a third one contradicts them: it keeps its own sign, which disagrees with its direction.
    w = principal_component(np.array([[1, 0.8, -0.5], [0.8, 1, -0.5], [-0.5, -0.5, 1]]))
    assert (w[:2] > 0).all() and w[2] < 0
    size, agrees = oriented(w)
    assert (size > 0).all() and agrees.tolist() == [True, True, False]


def test_loadings(spark):
    rng = np.random.default_rng(1)
    rows = [(1, k, str(a), str(a + rng.random() / 4), str(a + rng.random())) for k, a in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "q bigint, m bigint, a string, b string, c string")
    got = {r.score: (r.loading, r.agrees) for r in loadings(df, "q", "m", {"a": 1, "b": 1, "c": -1}).collect()}
    assert got["a"][0] > 0 and got["b"][0] > 0 and got["c"][0] < 0 and [got[c][1] for c in "abc"] == [True, True, False]
    assert rank_together(df, "q", "m", {"a": 1, "b": 1, "c": 1}).where("place = 1").count() == 1


SCHEMA = "q bigint, m bigint, a string, b string, n string, place string, g string"


def ranked(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "n", "p", "g") for r in rows], SCHEMA)
    return {(r.q, r.m): (r.rank_0, r.rank_1, r.place) for r in rank_together(df, "q", "m", {"a": 1, "b": 1}, **kw).collect()}


def test_scale_does_not_count(spark):
    rows = [(1, 1, "0.9", "10000"), (1, 2, "0.8", "20000"), (1, 3, "0.1", "1000000000"), (1, 4, "0.95", "15000")]
    got = ranked(spark, rows)
    assert got[1, 4][2] == 1
    assert got == ranked(spark, [(q, m, a, str(float(b) ** 0.1)) for q, m, a, b in rows])


def test_edges(spark):
    rows = [(1, 1, "0.5", None), (1, 2, "0.5", "3"), (1, 3, "bad", "NaN"), (1, 3, "bad", "NaN"), (2, 4, None, None), (None, 5, "1", "1"), (None, 6, "2", "2"), (3, None, "1", "1")]
    got = ranked(spark, rows)
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 4), (None, 5), (None, 6)}
    assert got[1, 2][2] == 1 and got[1, 3][2] == 3 and got[2, 4] == (1.0, 1.0, 1) and got[None, 6][2] == 1
    assert got[1, 1][0] == got[1, 2][0] == 0.75 and got[1, 1][1] == got[1, 3][1] == 0.25
    assert ranked(spark, []) == {}


def test_hot_group_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(1, k, str(round(rng.random(), 2)), None if k % 7 == 0 else str(rng.integers(1, 50))) for k in range(400)] + [(2, k, "1", "1") for k in range(1000, 1300)]
    got = ranked(spark, rows)
    assert sorted(p for (q, _), (_, _, p) in got.items() if q == 1) == list(range(1, 401))
    # All alike: the middle rank for each, in order of the item.
    assert [got[2, k][2] for k in range(1000, 1300)] == list(range(1, 301)) and {got[2, k][:2] for k in range(1000, 1300)} == {(0.5, 0.5)}
    a = np.array([float(r[2]) for r in rows[:400]])
    order = {r[1]: ((a < float(r[2])).sum() + ((a == float(r[2])).sum() - 1) / 2) / 399 for r in rows[:400]}
    assert all(got[1, k][0] == pytest.approx(v) for k, v in order.items())
    assert ranked(spark, [(1, 1, "1", None), (1, 1, None, "1")]).keys() == {(1, 1)}
