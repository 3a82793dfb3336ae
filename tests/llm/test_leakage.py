from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm.leakage import align, find_leaks, make_item, needed_score, words

ITEM = "The pine scheduler admits 549 jobs unless fern pressure exceeds 775 on quartz nodes while lichen tooling removes 830 gorse snapshots nightly and each yarrow digest covers 823 blocks"
W = ITEM.split()


def test_words_ignore_case_marks_and_disguise():
    a = words(pa.array(["The  naïve, way!\n> to FIND_it"])).hashes
    b = words(pa.array(["Тhe naïve way tо find it"])).hashes
    assert (a == b).all() and len(a) == 6
    assert len(words(pa.array(["索引は"])).hashes) == 3


def brute_align(item, doc):
    h = np.zeros((len(item) + 1, len(doc) + 1))
    fit = np.zeros_like(h)
    fit[:, 0] = np.arange(len(item) + 1)
    run = best = 0
    r = np.zeros_like(h)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(doc, 1):
            same = x == y
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            fit[i, j] = min(fit[i - 1, j - 1] + (not same), fit[i - 1, j] + 1, fit[i, j - 1] + 1)
            r[i, j] = r[i - 1, j - 1] + 1 if same else 0
            best, run = max(best, h[i, j]), max(run, r[i, j])
    return best / (2 * len(item)), run, fit[-1].min()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_alignment_equals_brute_force(item, doc):
    a = align(np.array(item, np.uint64), np.array(doc, np.uint64))
    assert (a.score, a.run, a.edits) == pytest.approx(brute_align(item, doc))


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, item_text string, doc_id string")
    return {(r.doc_id, r.item_id): r.kind for r in find_leaks(d, i, **kw).collect()}


def test_kinds_and_limits(spark):
    def swap(k):
        w = list(W)
        for n in range(k):
            w[(n * len(W)) // max(k, 1) + 2] = f"other{n}"
        return " ".join(w)

    k = len(W) // 8
    docs = [
        (1, f"before {ITEM.upper()} after", "x"), (2, "x " + " ".join(W[5:20]) + " y", "x"), (3, "x " + " ".join(W[5:19]) + " y", "x"), (4, f"a {swap(k)} b", None), (5, f"a {swap(k + 1)} b", "x"),
        (6, "# " + "\n# ".join(" ".join(W[i : i + 6]) for i in range(0, len(W), 6)), "x"), (7, None, "x"), (8, "", "x"), (None, ITEM, "x"), (1, f"before {ITEM.upper()} after", "x"), (9, "filler " * 60_000 + ITEM, "x"), (10, "short one", "x"),
    ]
    items = [(100, ITEM, "x"), (100, ITEM, "x"), (101, None, "x"), (102, "...", "x"), (None, ITEM, "x"), (103, "short one", "x")]
    got = leaks(spark, docs, items)
    assert got == {(1, 100): "whole", (2, 100): "passage", (4, 100): "edited", (6, 100): "whole", (9, 100): "whole", (10, 103): "whole"}
    assert leaks(spark, docs, items, block_words=10) == got
    assert leaks(spark, [], items) == {} and leaks(spark, docs, []) == {}


def test_seeds_lose_no_leak(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([4, 9, 16, 30, 55])))) for k in range(25)]
    docs = []
    for n in range(120):
        body = rng.choices(vocabulary, k=40)
        it = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(it) // 6)):
            it[rng.randrange(len(it))] = rng.choice(vocabulary)
        cut = rng.choice([it, it[: rng.randint(10, 60)]])
        docs.append((n, " ".join(body[:20] + cut + body[20:])))
    want = set()
    for d, t in docs:
        dw = words(pa.array([t])).hashes
        for i, x in items:
            iw = words(pa.array([x])).hashes
            a = align(iw, dw)
            if a.run >= min(15, len(iw)) or a.edits <= len(iw) // 8:
                want.add((d, i))
    got = set(leaks(spark, [(d, t, "") for d, t in docs], [(i, x, "") for i, x in items]))
    assert got == want and len(want) > 60


def test_tables_give_what_the_broadcast_gives(spark):
    """Beyond the bound seeds are joined; repeated phrases and two texts under one id included."""
    twice = " ".join(["so it goes and so it goes again"] * 3)
    items = [(1, ITEM), (2, twice), (3, "tiny one"), (3, "another tiny text of eight different plain words"), (4, ITEM.replace("pine", "oak"))]
    docs = [(1, f"a {ITEM} b"), (2, f"x {twice} y"), (3, "so it goes and so it goes again"), (4, "no tiny one here"), (5, "another tiny text of eight different plain words"), (6, " ".join(W[3:18])), (7, "nothing")]
    rows = ([(d, t, "") for d, t in docs], [(i, t, "") for i, t in items])
    got = leaks(spark, *rows)
    assert got == leaks(spark, *rows, block_words=1) and {(1, 1), (1, 4), (2, 2), (4, 3), (5, 3), (6, 1)} <= set(got) and got[1, 4] == "edited"


def test_the_score_gates():
    item = words(pa.array([ITEM])).hashes
    assert needed_score(30, 15, 8) == 30 and needed_score(8, 15, 8) == 13
    assert align(item, item[:14], needed_score(len(item), 15, 8)) is None and align(item, item[:15], needed_score(len(item), 15, 8)).run == 15


def test_least_common_grams_is_positive():
    for n in range(1, 200):
        it = make_item(1, np.arange(n, dtype=np.uint64), 15, 5, 8)
        assert it.q >= 1 and it.least >= 1
