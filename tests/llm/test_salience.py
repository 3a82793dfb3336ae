from __future__ import annotations

import numpy as np
import pytest

from lodeseek.llm.salience import count_terms, parsimonious, term_scores


def test_counts():
    t = "fooBar fooBar.x $fooBar fooBar_ (fooBar) fooBar2 éfooBar a-b a-b2"
    assert count_terms(["fooBar", "a-b", "none"], t) == [4, 1, 0]


def slow(tf, bg, own=0.1, rounds=50):
    p = [x / sum(tf) for x in tf]
    for _ in range(rounds):
        e = [t * own * q / ((1 - own) * b + own * q) for t, q, b in zip(tf, p, bg, strict=True)]
        p = [x / sum(e) for x in e]
    return p


def test_em_equals_slow_version():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 9]
    tf = np.concatenate([rng.integers(1, 9, n) for n in sizes]).astype(float)
    bg = rng.uniform(0.001, 0.4, len(tf))
    starts = np.cumsum(sizes) - sizes
    got, took = parsimonious(tf, bg, starts, rounds=50, tolerance=0)
    assert took.tolist() == [-1, -1, -1]
    want = np.concatenate([slow(tf[a : a + n], bg[a : a + n]) for a, n in zip(starts, sizes, strict=True)])
    assert got == pytest.approx(want, abs=1e-9)
    assert np.add.reduceat(got, starts) == pytest.approx(np.ones(3))
    # A record's model and its number of rounds don't depend on the records beside it.
    both, rounds = parsimonious(tf, bg, starts)
    for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        alone, one = parsimonious(tf[a : a + n], bg[a : a + n], np.array([0]))
        assert alone == pytest.approx(both[a : a + n], abs=1e-15) and one[0] == rounds[k] > 0
    assert parsimonious(np.zeros(2), np.array([0.1, 0.2]), np.array([0]))[0].tolist() == [0, 0]


def test_table(spark):
    rows = [
        (1, "common rareOne", "common common common rareOne rareOne rareOne", "x", "y"), (1, "common rareOne", "common common common rareOne rareOne rareOne", "x", "y"), (2, "common  common other", "common", "x", "y"), (3, "common rareOne", None, None, None),
        (4, None, "text", "x", "y"), (5, "", "text", "x", "y"), (6, "  ", "t", "x", "y"), (None, "common", "common", "x", "y"), (7, "common", "common " * 50_000, "x", "y"),
    ]
    df = spark.createDataFrame(rows, "id bigint, identifiers string, chunk_text string, term string, score string")
    got = {(r.id, r.term): r for r in term_scores(df).collect()}
    assert set(got) == {(1, "common"), (1, "rareOne"), (2, "common"), (2, "other"), (3, "common"), (3, "rareOne"), (7, "common")}
    assert (got[1, "common"].tf, got[1, "common"].df, got[3, "rareOne"].tf, got[1, "rareOne"].df, got[7, "common"].tf) == (3, 4, 0, 2, 50_000)
    assert got[2, "other"].tf == 0 and got[2, "other"].score == 0 and got[3, "common"].score == 0 and all(r.rounds > 0 for r in got.values())
    assert got[1, "rareOne"].score > got[1, "common"].score
    assert term_scores(df.limit(0)).count() == 0
