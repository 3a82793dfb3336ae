from __future__ import annotations

import itertools

import pytest

from lodeseek.llm.mixing import min_cost_flow, mix_sources


def test_flow_sends_most_at_least_cost():
    # Tokens reach two sources; the shared set serves what the others can't, before anything is repeated twice.
    flow = min_cost_flow([100, 50, 80], [{0: 300}, {1: 100}, {0: 160, 1: 160}], [150.0, 90.0], [3, 2, 2])
    assert sum(f.get(0, 0) for f in flow) == pytest.approx(150) and sum(f.get(1, 0) for f in flow) == pytest.approx(90)
    assert sum(flow[0].values()) <= 110.001 and sum(flow[2].values()) <= 81


def cost(total, tokens, layers):
    return sum(min(max(total - tokens * (j - 1), 0), tokens) * j * j for j in range(1, layers + 1))


def test_flow_against_all_splits():
    supply, reach, quota, layers = [4, 3], [{0: 8}, {0: 6, 1: 6}], [9.0, 5.0], [2, 2]
    flow = min_cost_flow(supply, reach, quota, layers)
    sent = sum(sum(f.values()) for f in flow)
    best = None
    for a, b, c in itertools.product(range(9), range(7), range(7)):
        if a + b <= 9 and c <= 5 and b + c <= 6:
            best = min(best or (0, 1e9), (-(a + b + c), cost(a, 4, 2) + cost(b + c, 3, 2)))
    assert (-sent, cost(sum(flow[0].values()), 4, 2) + cost(sum(flow[1].values()), 3, 2)) == pytest.approx(best)


DOCS = "doc_id bigint, text string, source string, tokens string, pattern string"
TARGETS = "source string, target_share double, max_repeats int, times string"


def run(spark, docs, targets, **kw):
    m = mix_sources(spark.createDataFrame([(*d, "t", "p") for d in docs], DOCS), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **kw)
    return {r.source: r for r in m.report.collect()}, m.selection.collect()


def test_mix(spark):
    docs = [(k, "alpha beta gamma delta " * 5, " Repo-Code ") for k in range(300)] + [(1000 + k, "one two three four " * 5, "WIKI") for k in range(20)] + [(2000 + k, "x y z " * 5, "untargeted") for k in range(30)]
    docs += [(1, docs[1][1], " Repo-Code "), (5000, None, "wiki"), (5001, "", "wiki"), (None, "a b", "wiki"), (5002, "text here", None), (7000, "long " * 30_000, "repo_code")]
    report, chosen = run(spark, docs, [("repo_code", 0.6, 1), ("wiki", 0.3, 3), ("mail", 0.1, 5), (None, 0.2, 1), ("none", None, None)])
    assert {s for s, r in report.items() if r.short} == {"wiki", "mail"} and report["mail"].documents == 0 and report["wiki"].documents == 22
    assert report["repo_code"].documents == 301
    assert max(r.times for r in chosen if r.source == "wiki") == 3 and {r.doc_id for r in chosen if r.source == "wiki"} >= set(range(1000, 1020))
    assert max(r.times for r in chosen if r.source == "repo_code") == 1
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_shares_are_met(spark):
    docs = [(k, "alpha beta gamma " * (1 + k % 7), "a" if k % 3 else "b") for k in range(900)]
    report, chosen = run(spark, docs, [("a", 0.5, 2), ("b", 0.5, 4)])
    for s in "ab":
        assert report[s].actual_tokens == pytest.approx(report[s].target_tokens, rel=0.02)
    assert {r.times for r in chosen if r.source == "b"} == {1, 2}
    assert run(spark, docs, [("a", 0.5, 2), ("b", 0.5, 4)])[1] == chosen or sorted(run(spark, docs, [("a", 0.5, 2), ("b", 0.5, 4)])[1]) == sorted(chosen)


def test_overlapping_sources(spark):
    docs = [(k, "alpha beta gamma " * 4, "a") for k in range(200)] + [(k, "alpha beta gamma " * 4, "b") for k in range(100, 300)]
    report, chosen = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert not any(r.short for r in report.values())
    used = {}
    for r in chosen:
        used[r.doc_id] = used.get(r.doc_id, 0) + r.times
    assert max(used.values()) == 1
    for s in "ab":
        assert report[s].actual_tokens == pytest.approx(report[s].target_tokens, rel=0.03)


def test_empty(spark):
    report, chosen = run(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and report["a"].actual_tokens == 0 and report["a"].target_tokens == 0
    report, chosen = run(spark, [(1, "a b", "a")], [])
    assert report == {} and chosen == []


def test_too_many_targets_are_an_error(spark):
    targets = [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)]
    with pytest.raises(ValueError, match="2 targets"):
        run(spark, [(1, "x y", "a")], targets, max_patterns=2)
    assert len(run(spark, [(1, "x y", "a")], targets, max_patterns=3)[0]) == 3


def test_rebalancing_and_code_points(spark):
    docs = [(k, "abcd", "a") for k in range(100)] + [(k, "abcd", "b") for k in range(100, 110)] + [(k, "abcd", "c") for k in range(200, 300)]
    targets = [("a", 0.4, 1), ("b", 0.4, 1), ("c", 0.2, 2)]
    report, _ = run(spark, docs, targets, vocabulary=None, size=400)
    assert report["a"].available_tokens == 400 and report["b"].short and report["b"].actual_tokens == 40
    assert report["a"].share_of_wanted == pytest.approx(0.4, abs=0.02) and sum(r.actual_tokens for r in report.values()) < 300
    report, chosen = run(spark, docs, targets, vocabulary=None, size=400, rebalance=True)
    assert sum(r.actual_tokens for r in report.values()) == pytest.approx(400, abs=16) and report["b"].short and not report["a"].short
    assert report["a"].actual_tokens / report["c"].actual_tokens == pytest.approx(2, rel=0.1)


def test_large_flow_is_quick():
    rng = __import__("random").Random(3)
    n, m = 20_000, 50
    reach = [{s: 500 for s in rng.sample(range(m), 3)} for _ in range(n)]
    flow = min_cost_flow([100] * n, reach, [30_000.0] * m, [5] * n)
    assert sum(sum(f.values()) for f in flow) == pytest.approx(1_500_000) and max(sum(f.values()) for f in flow) <= 200.001
