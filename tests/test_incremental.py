from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeseek.operators.incremental import StateStore, completed_state, new_or_changed, plain_path, row_hash, run_once

LOG = "run_no int, file_path string, file_hash string, outcome string, logged_at timestamp, key string"
ROWS = "id bigint, file_path string, file_hash string, key string, state_hash string"


def log(spark, rows):
    return spark.createDataFrame(rows, "run_no int, file_path string, file_hash string, outcome string, at string, key string").selectExpr("run_no", "file_path", "file_hash", "outcome", "cast(at as timestamp) logged_at", "key")


def test_found_rows(spark):
    state = completed_state(
        log(spark, [(1, "src\\a.ts", "AA", "committed", "2031-01-01", "k"), (1, "src\\a.ts", "AA", "committed", "2031-01-01", "k"), (2, "./src/a.ts", "BB", "committed", "2031-02-01", "k"), (3, "src/a.ts", "CC", "failed", "2031-03-01", "k"), (3, "b.ts", "X", "started", "2031-03-01", "k"), (1, None, "X", "committed", "2031-03-01", "k"), (1, "d.ts", None, "committed", "2031-03-01", "k")])
    )
    assert {(r.key, r.state_hash) for r in state.collect()} == {("src/a.ts", "bb"), ("d.ts", None)}
    rows = spark.createDataFrame([(1, "src/a.ts", "bb", "k", "s"), (2, "src/a.ts", "Bb", "k", "s"), (3, "src/a.ts", "cc", "k", "s"), (3, "src/a.ts", "cc", "k", "s"), (4, "b.ts", "x", None, None), (5, None, "x", "k", "s"), (6, "d.ts", None, "k", "s"), (7, "d.ts", "q", "k", "s")], ROWS)
    got = new_or_changed(rows, state, plain_path(F.col("file_path")), F.col("file_hash"))
    assert sorted(r.id for r in got.collect()) == [3, 4, 5, 7] and got.columns == rows.columns
    assert new_or_changed(rows.limit(0), state, F.col("file_path"), F.col("file_hash")).count() == 0
    assert new_or_changed(rows, state.limit(0), F.col("file_path"), F.col("file_hash")).count() == 7


def test_row_hash_keeps_borders(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None)], "a string, b string")
    assert df.select(row_hash("a", "b").alias("h")).distinct().count() == 4


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    (tmp_path / "state").mkdir()
    done = []
    v1 = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, h string")
    work = lambda rows, number: done.append({(r.k, r.h) for r in rows.collect()})
    assert run_once(store, v1, F.col("k"), F.col("h"), work) == 2
    assert run_once(store, v1, F.col("k"), F.col("h"), work) == 0
    v2 = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "k string, h string")

    def dies(rows, number):
        rows.collect()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        run_once(store, v2, F.col("k"), F.col("h"), dies)
    assert run_once(store, v2, F.col("k"), F.col("h"), work) == 2
    assert done == [{("a", "1"), ("b", "1")}, {("a", "2"), ("c", "1")}]
    assert {(r.key, r.state_hash) for r in store.read().collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    assert store.vacuum() == 0 and store.vacuum(-60) == 0 and store.read().count() == 3


def test_a_dead_run_blocks_nobody(spark, tmp_path):
    """Whatever a run leaves behind that died while it committed, the next one goes through."""
    store = StateStore(spark, str(tmp_path))
    row = lambda k, h: spark.createDataFrame([(k, h)], "key string, state_hash string")
    assert store.commit(row("a", "1"), None) == 0
    (tmp_path / ".draft-x").write_text("{")
    (tmp_path / "layer-1-dead").mkdir()
    (tmp_path / "LOCK").write_text("")
    assert store.commit(row("b", "1"), 0) == 1 and store.read().count() == 2
    assert store.vacuum(-60) == 1 and not (tmp_path / ".draft-x").exists() and store.read().count() == 2 and store.version() == 1


def test_layers_merge(spark, tmp_path):
    store = StateStore(spark, str(tmp_path), max_layers=2)
    row = lambda k, h: spark.createDataFrame([(k, h)], "key string, state_hash string")
    for n, (k, h) in enumerate([("a", "1"), ("b", "1"), ("a", "2"), ("a", "3"), ("c", None)]):
        assert store.commit(row(k, h), n - 1 if n else None) == n
    assert {tuple(r) for r in store.read().collect()} == {("a", "3"), ("b", "1"), ("c", None)}
    assert {tuple(r) for r in store.read(1).collect()} == {("a", "1"), ("b", "1")}


def test_keys_with_several_hashes_settle(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), (None, "1"), ("c", None)], "k string, h string")
    runs = [run_once(store, rows, F.col("k"), F.col("h"), lambda r, n: None) for _ in range(3)]
    assert runs == [5, 1, 1]  # the row without a key comes each time
    fewer = rows.where("h is null or h <> '2'")
    assert run_once(store, fewer.where("k is not null"), F.col("k"), F.col("h"), lambda r, n: None) == 0
    assert run_once(store, spark.createDataFrame([("a", "3")], "k string, h string"), F.col("k"), F.col("h"), lambda r, n: None) == 1
    assert run_once(store, rows.where("k = 'a'"), F.col("k"), F.col("h"), lambda r, n: None) == 2


def test_only_one_of_two_runs_commits(spark, tmp_path):
    (tmp_path / "s").mkdir()
    store = StateStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "1")], "key string, state_hash string")
    began = store.version()
    store.commit(rows, began)
    with pytest.raises(RuntimeError, match="another run"):
        store.commit(rows, began)
