"""Queries about settings, lists, files with front matter and the engine as a whole, and their SQL."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek import config as C
from lodeseek import tools
from lodeseek.embedding import HashEmbedder, embed_queries
from lodeseek.engine import Engine
from lodeseek.functions.paths import expand_home, relative_to, resolve_from
from lodeseek.functions.scoring import fixed3
from lodeseek.plans import index
from lodeseek.safety import SafetyLists
from lodeseek.session import session_path
from lodeseek.sources import markdown
from lodeseek.sources.corpora import table


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").select("file_path").distinct()
    root = F.lit("/repo")
    return p.select("file_path", resolve_from(root, F.col("file_path")).alias("resolved"), relative_to(root, F.concat(F.lit("/repo/"), "file_path")).alias("relative"), expand_home(F.concat(F.lit("~/"), "file_path"), F.lit("/home/x")).alias("expanded"))


def three_decimals(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "search_matches").select("match_id", F.expr("try_cast(score as double)").alias("x")).distinct().where("x is not null")
    return m.select("match_id", fixed3(F.col("x") + F.lit(0.0001)).alias("shown"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The query log embedded with a prefix: how long each vector is, and that no text has none."""
    q = table(spark, d, "search_queries").where("query_text is not null").select("query_id", "query_text")
    v = embed_queries(q, HashEmbedder(32), "search_query: ")
    norm = F.sqrt(F.aggregate(F.transform("query_vector", lambda x: (x * x).cast("double")), F.lit(0.0), lambda a, x: a + x))
    return v.select("query_id", F.size("query_vector").alias("dimensions"), F.round(norm, 3).alias("length"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown with front matter, read back: name, size and the length of the body."""
    text = F.concat(F.lit("---\nname: '"), F.trim("source"), F.lit("'\nnested:\n  size: "), F.col("n_chars"), F.lit("\n  kept: true\n---\n"), F.col("text"))

    @F.pandas_udf("name string, size bigint, kept boolean, body string")
    def read(t: pd.Series) -> pd.DataFrame:
        rows = [markdown.entry(x, "body") for x in t]
        return pd.DataFrame({"name": [r.get("name") for r in rows], "size": [r["nested"]["size"] for r in rows], "kept": [r["nested"]["kept"] for r in rows], "body": [r.get("body") for r in rows]})

    e = table(spark, d, "documents").where("source is not null and n_chars is not null and text is not null").select("doc_id", read(text).alias("e"))
    return e.select("doc_id", F.col("e.name").alias("name"), F.col("e.size").alias("size"), F.col("e.kept").alias("kept"), F.col("e.body").isNotNull().alias("has_body"))


def coverage_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report for each event, with its numbers as percentages; every tenth has no line for all files."""
    line = F.concat(F.lit("File | % Funcs | % Lines |\n"), F.when(F.col("event_id") % 10 == 0, "some files").otherwise("All files"), F.lit("   |   "), F.col("event_id") % 101, F.lit(".5 |  "), F.col("user_id") % 101, F.lit(" | 1-2\n"))
    return markdown.coverage(table(spark, d, "events").select("event_id", line.alias("text"))).drop("text")


def settings(spark: SparkSession, d: str) -> DataFrame:
    """What layered settings, dot-paths and typed values come to, one case a row."""
    merged = C.merge({"a": 1, "l": ["x"], "o": {"p": 1, "q": 2}}, {"a": 2, "l": ["x", "y"]}, {"o": {"q": 3}, "n": None})
    put = C.put({"a": {"b": 1}}, "a.c.d", 5)
    rows = [("merge", merged), ("flatten", dict(C.flatten(merged))), ("get", [C.get(merged, "o.q"), C.get(merged, "o.z")]), ("put", put), ("drop", C.drop(put, "a.c.d"))]
    rows += [(f"parse {raw}", C.parse_value(raw, default)) for raw, default in (("true", False), ("12", 1), ("0.5", 1.0), ("a, b", []), ('["c"]', []), ("text", ""))]
    return spark.createDataFrame([(k, json.dumps(v, separators=(",", ":"))) for k, v in rows], "step string, result string")


def folder_lists(spark: SparkSession, d: str) -> DataFrame:
    """A safety file through its life, one step a row."""
    with tempfile.TemporaryDirectory() as t:
        s = SafetyLists(Path(t) / "s.json", "/home/x")
        steps = [("defaults", s.show("blacklist")), ("added", s.add("blacklist", "/srv/a")), ("again", s.add("blacklist", "/srv/a")), ("barred", [s.is_blacklisted(p) for p in ("/srv/a", "/srv/a/b", "/home", "/home/x/y")]), ("allowed", s.add("whitelist", "/srv"))]
        steps += [("not barred", [s.is_blacklisted("/srv/a"), s.is_whitelisted("/srv/a/b")]), ("removed", s.remove("whitelist", "/srv")), ("barred again", [s.is_blacklisted("/srv/a")])]
        s.clear("blacklist")
        steps.append(("cleared", s.show("blacklist")))
    return spark.createDataFrame([(k, json.dumps(v, separators=(",", ":"))) for k, v in steps], "step string, result string")


def enabled(spark: SparkSession, d: str) -> DataFrame:
    """Tools and hooks that are left when some are switched off, bundled entries merged, and output as text."""
    tree = C.merge(C.DEFAULTS, {"disabled_tools": ["reindex", "blacklist"], "disabled_hooks": ["grep-redirect"], "hooks": {"auto_sync": False}})
    host = tools.Host(Engine(spark, session_path(spark, "none"), settings=tree), C.ProjectConfig("none.json"), SafetyLists("none.json", "/home/x"), lambda: index.listing(spark, d), lambda: 0)
    rows = [("tool", x) for x in tools.tools(host)] + [("hook", x) for x in tools.hooks(host)]
    rows += [("skill", x) for x in markdown.with_bundled({"skills": {"paths": ["own"]}}, {}, {}, ["bundled", "own"])["skills"]["paths"]]
    rows += [("output", tools.to_tool_output("text")), ("output", tools.to_tool_output({"a": [1]}))]
    return spark.createDataFrame(rows, "kind string, name string")


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, session_path(spark, "index"), settings=C.merge(C.DEFAULTS, {"indexing": {"max_files": 10**9}}), buckets=8)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return index.listing(spark, d).withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def engine_sync(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that a first sync of all documents stores, read back from the index."""
    e = _engine(spark)
    e.sync(_files(spark, d))
    c = e.warehouse.read("chunks")
    return c.select("file_path", "chunk_index", "start_line", "end_line", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), "file_hash", F.size("embedding").alias("dimensions"))


def engine_steps(spark: SparkSession, d: str) -> DataFrame:
    """An index through its life: what each step says, and how many files it concerned."""
    e, files = _engine(spark), _files(spark, d)
    first = files.where("file_path like 'notes/%'").orderBy("file_path").limit(1)
    edited = first.withColumn("content", F.lit("# edited\nby hand"))
    steps: list[tuple[str, str, int]] = []

    def synced(name: str, out: dict) -> None:
        steps.append((name, out["outcome"], out.get("indexed_files", 0)))

    steps.append(("reembed before", e.reembed(first), 0))
    synced("sync", e.sync(files, parts=2))
    synced("sync again", e.sync(files))
    steps.append(("reembed unchanged", e.reembed(first), 0))
    steps.append(("reembed edited", e.reembed(edited), 0))
    steps.append(("reembed barred", e.reembed(first.withColumn("file_path", F.lit("dist/x.ts"))), 0))
    said = e.collect_garbage(files.where("file_path not like 'notes/%'"), 10**7)
    steps.append(("garbage", said.split(":")[0], int(said.split(":")[1])))
    steps.append(("garbage again", e.collect_garbage(files, 10**7 + 1), 0))
    synced("sync brings back", e.sync(files))
    steps.append(("terminate", e.terminate()["status"], 0))
    e.embedder = HashEmbedder(8)
    synced("other dimensions", e.sync(files))
    synced("reindex", e.reindex(files))
    state = e.warehouse.state()
    steps.append(("state", ",".join(f"{k}={state[k]}" for k in ("embedding_dimensions", "schema_version", "sync_status")), e.warehouse.read("chunks").select("file_path").distinct().count()))
    steps.append(("healthy", str(e.health().first().healthy).lower(), e.status().first().files_indexed))
    return spark.createDataFrame(steps, "step string, outcome string, files bigint")


QUERIES = {f.__name__: f for f in (path_functions, three_decimals, query_vectors, front_matter, coverage_reports, settings, folder_lists, enabled, engine_sync, engine_steps)}


def _rows(rows: list[tuple[str, str]], names: str) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({names})"


_FIT = f"fit as (select row_number() over (order by file_path) doc_id, file_path, content as text from listing where {index._any(index._INDEXING['include'])} and not {index._any(index._INDEXING['exclude'])} and octet_length(encode(content)) <= 512000)"
_LIVE = index._LISTING.replace("docs as (", "docs0 as (", 1).replace("from docs group", "from docs0 group")

SQL = {
    "path_functions": "select distinct file_path, '/repo/' || file_path as resolved, file_path as relative, '/home/x/' || file_path as expanded from chunks",
    "three_decimals": "select distinct match_id, printf('%.3f', try_cast(score as double) + 0.0001) as shown from search_matches where try_cast(score as double) is not null",
    "query_vectors": "select query_id, cast(32 as integer) as dimensions, cast(1 as double) as length from search_queries where query_text is not null",
    "front_matter": "select doc_id, trim(source) as name, n_chars as size, true as kept, regexp_matches(text, '\\S') as has_body from documents where source is not null and n_chars is not null and text is not null",
    "coverage_reports": "select event_id, case when event_id % 10 > 0 then event_id % 101 + 0.5::double end as functions, case when event_id % 10 > 0 then (user_id % 101)::double end as lines, case when event_id % 10 > 0 then event_id % 101 >= 90 and user_id % 101 >= 90 end as enough from events",
    "settings": _rows(
        [("merge", '{"a":2,"l":["x","y"],"o":{"p":1,"q":3}}'), ("flatten", '{"a":2,"l":["x","y"],"o.p":1,"o.q":3}'), ("get", "[3,null]"), ("put", '{"a":{"b":1,"c":{"d":5}}}'), ("drop", '{"a":{"b":1}}'),
         ("parse true", "true"), ("parse 12", "12"), ("parse 0.5", "0.5"), ("parse a, b", '["a","b"]'), ('parse ["c"]', '["c"]'), ("parse text", '"text"')], "step, result"),
    "folder_lists": _rows(
        [("defaults", '["/","/home","/home/x"]'), ("added", '["/srv/a"]'), ("again", '["/srv/a"]'), ("barred", "[true,false,true,false]"), ("allowed", '["/srv"]'), ("not barred", "[false,true]"), ("removed", "[]"), ("barred again", "[true]"), ("cleared", '["/","/home","/home/x"]')], "step, result"),
    "enabled": _rows(
        [("tool", x) for x in ("search", "index", "status", "run_indexer", "terminate_indexer", "config", "whitelist")] + [("hook", x) for x in ("file.edited", "tool.execute.after", "session.compacting")] + [("skill", "own"), ("skill", "bundled"), ("output", "text"), ("output", '{\n  "a": [\n    1\n  ]\n}')], "kind, name"),
    "engine_sync": f"""
with recursive {_LIVE}, {_FIT}, docs as (select * from fit), {index._SYNTAX}, {index._FIXED},
cut as (select doc_id, chunk_index, start_line, end_line, body from syn union all select doc_id, chunk_index, start_line, end_line, body from fix where doc_id not in (select doc_id from syn))
select file_path, chunk_index, start_line, end_line, md5(body) as text_md5, sha256(text) as file_hash, cast(64 as integer) as dimensions from cut join docs using (doc_id)""",
    "engine_steps": f"""
with {_LIVE}, {_FIT}, n as (select count(*) files, count(*) filter (file_path like 'notes/%') notes from fit)
select unnest(['reembed before', 'sync', 'sync again', 'reembed unchanged', 'reembed edited', 'reembed barred', 'garbage', 'garbage again', 'sync brings back', 'terminate', 'other dimensions', 'reindex', 'state', 'healthy']) as step,
  unnest(['skipped', 'ok', 'ok', 'unchanged', 'reembedded', 'skipped', 'removed', 'debounced', 'ok', 'no_process', 'dimension-mismatch', 'ok', 'embedding_dimensions=8,schema_version=2,sync_status=idle', 'true']) as outcome,
  unnest([0, files, 0, 0, 0, 0, notes, 0, notes, 0, 0, files, files, files]) as files from n""",
}
