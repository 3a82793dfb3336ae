"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.incremental import StateStore, completed_state, plain_path, run_once
from lodeseek.session import session_path


def _store(spark: SparkSession) -> StateStore:
    return StateStore(spark, session_path(spark, "state"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/chunks.parquet").select("id", "file_path", "file_hash")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/indexed_files.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the run after the failed one processes: the log's completed hashes become the state, and one run is made against it."""
    store, out = _store(spark), {}
    store.commit(completed_state(_log(spark, d)), None)

    def work(changed: DataFrame, number: int) -> None:
        changed.select("id").distinct().write.mode("overwrite").parquet(f"{store.folder}/out-{number}")
        out["path"] = f"{store.folder}/out-{number}"

    run_once(store, _chunks(spark, d), plain_path(F.col("file_path")), F.col("file_hash"), work)
    return spark.read.schema("id bigint").parquet(out["path"]) if out else spark.createDataFrame([], "id bigint")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Four runs over all chunks, in order: one that dies after half its work, its repetition, one with nothing changed, and one after the files of one folder were changed. run_no, outcome, and the rows each processed."""
    store, rows, key = _store(spark), _chunks(spark, d), plain_path(F.col("file_path"))
    store.commit(completed_state(_log(spark, d)), None)
    edited = rows.withColumn("file_hash", F.when(F.col("file_path").startswith("src/"), F.concat("file_hash", F.lit("-edited"))).otherwise(F.col("file_hash")))
    done: list[tuple[int, str, int]] = []

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{store.folder}/out-{number}")

    def dies(changed: DataFrame, number: int) -> None:
        write(changed.where("id % 2 = 0"), number)
        raise InterruptedError

    for no, (table, work) in enumerate(((rows, dies), (rows, write), (rows, write), (edited, write)), 1):
        before = store.version()
        try:
            run_once(store, table, key, F.col("file_hash"), work)
        except InterruptedError:
            done.append((no, "failed", 0))
            continue
        new = store.version() != before
        done.append((no, "committed" if new else "nothing to do", spark.read.parquet(f"{store.folder}/out-{store.version()}").count() if new else 0))
    return spark.createDataFrame(done, "run_no int, outcome string, processed bigint")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """What was completed: each file's latest committed hash."""
    return completed_state(_log(spark, d))


_STATE = r"""
select key, max_by(h, (logged_at, run_no)) as state_hash from (
  select regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') as key, lower(file_hash) as h, logged_at, run_no
  from indexed_files where outcome = 'committed') where key is not null group by key
"""
_KEYED = rf"""
with state as ({_STATE}),
k as (select distinct id, file_path, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') key, lower(file_hash) h from chunks),
first as (select k.* from k left join state s using (key) where s.key is null or h is distinct from s.state_hash)
"""

SQL = {
    "p3_state": _STATE,
    "p3_found": _KEYED + "select distinct id from first",
    "p3_runs": _KEYED
    + """, edited as (select distinct id, key, case when starts_with(file_path, 'src/') then h || '-edited' else h end h from k),
last as (select e.id from edited e where not exists (select 1 from k where k.key = e.key and k.h = e.h and exists (select 1 from first f where f.key = e.key))
  and not exists (select 1 from state s where s.key = e.key and s.state_hash = e.h and not exists (select 1 from first f where f.key = e.key)))
select cast(1 as integer) as run_no, 'failed' as outcome, cast(0 as bigint) as processed
union all select 2, 'committed', (select count(*) from first)
union all select 3, 'nothing to do', 0
union all select 4, 'committed', (select count(*) from last)""",
}

QUERIES = {"p3_found": p3_found, "p3_runs": p3_runs, "p3_state": p3_state}
