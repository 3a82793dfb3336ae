"""Queries about building, keeping and describing the index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek import config as C
from lodeseek.functions.paths import ancestors, base_name, extension
from lodeseek.functions.paths import file_type_multiplier as _multiplier
from lodeseek.functions.paths import glob_regex
from lodeseek.functions.scoring import cosine
from lodeseek.operators import maintain, status
from lodeseek.operators.chunking import BOUNDARIES, chunk_files
from lodeseek.operators.eligibility import is_blacklisted, redirects_grep, should_index, whitelisted_paths
from lodeseek.sources.corpora import chunks, document_files, table

_INDEXING = C.DEFAULTS["indexing"]
IGNORED = ["src/legacy/**"]


def listing(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files, the latest text of each path."""
    f = document_files(spark, d)
    return f.groupBy("file_path").agg(F.max_by("content", "doc_id").alias("content"))


def _eligible():  # noqa: ANN202
    return should_index(F.col("file_path"), F.col("size_bytes"), _INDEXING["include"], _INDEXING["exclude"], IGNORED, _INDEXING["max_file_size_kb"])


def eligible_files(spark: SparkSession, d: str) -> DataFrame:
    files = listing(spark, d).select("file_path", F.octet_length("content").alias("size_bytes"))
    stored = chunks(spark, d, "id", "file_path", "chunk_text").groupBy("file_path").agg(F.sum(F.octet_length("chunk_text")).alias("size_bytes"))
    return files.unionByName(stored).where(_eligible())


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return listing(spark, d).select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def _cut(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    cut = chunk_files(document_files(spark, d), strategy=strategy)
    return cut.select("doc_id", "chunk_index", "start_line", "end_line", F.length("chunk_text").alias("chars"), F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, "fixed")


def hybrid_chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, "hybrid")


def syntax_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the files that have syntax boundaries."""
    from lodeseek.operators.chunking import lines_of, syntax_spans

    f = document_files(spark, d).withColumn("s", F.explode(syntax_spans(F.col("content"), F.col("file_path"))))
    body = F.array_join(F.slice(lines_of(F.col("content")), F.col("s.start_line"), F.col("s.end_line") - F.col("s.start_line") + 1), "\n")
    return f.select("doc_id", "s.*", F.length(body).alias("chars"), F.md5(body.cast("binary")).alias("text_md5"))


def file_type_multiplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("file_path").distinct().select("file_path", _multiplier(F.col("file_path")).alias("multiplier"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("file_path").distinct().select("file_path", base_name(F.col("file_path")).alias("base"), extension(F.col("file_path")).alias("extension"))


def grep_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Would the query log's texts, and some code-like ones made of them, be redirected?"""
    q = table(spark, d, "search_queries").where("query_text is not null").select("query_id", F.explode(F.array("query_text", F.concat("query_text", F.lit("(.*)")), F.element_at(F.split("query_text", " "), -1), F.concat(F.lit("src/"), "query_text"), F.concat(F.lit("TODO "), "query_text"))).alias("pattern"))
    path = F.when(F.col("query_id") % 3 == 0, "src/").when(F.col("query_id") % 3 == 1, "src/a.ts")
    mode = F.when(F.col("query_id") % 4 == 0, "count")
    return q.withColumn("path", path).withColumn("mode", mode).select("query_id", "pattern", redirects_grep(F.col("pattern"), F.col("path"), F.col("mode")).alias("redirect")).distinct()


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return status.index_stats(chunks(spark, d, "id", "file_path"))


def file_stats(spark: SparkSession, d: str) -> DataFrame:
    return status.file_stats(chunks(spark, d, "id", "file_path", "updated_at"))


def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return status.extension_counts(table(spark, d, "chunks").select("file_path"))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    stored = chunks(spark, d, "id", "file_path", "chunk_text")
    files = stored.groupBy("file_path").agg(F.sum(F.octet_length("chunk_text")).alias("size_bytes"))
    return status.coverage(stored, files, _eligible())


def _current(spark: SparkSession, d: str) -> DataFrame:
    """What the log's last entry of each path says the file is now."""
    from lodeseek.operators.incremental import plain_path

    log = table(spark, d, "indexed_files").distinct()
    return log.groupBy(plain_path(F.col("file_path")).alias("file_path")).agg(F.lower(F.max_by("file_hash", F.struct("logged_at", "run_no", "outcome"))).alias("content_hash"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return maintain.changed_files(_current(spark, d), chunks(spark, d, "id", "file_path", "chunk_index", "file_hash"))


def gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return maintain.gc_candidates(chunks(spark, d, "id", "file_path"), _current(spark, d))


def listing_union(spark: SparkSession, d: str) -> DataFrame:
    return maintain.listing_union(table(spark, d, "chunks"), _current(spark, d), document_files(spark, d))


def _rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Indexed files cut anew to half their chunks, with one chunk more where they have an even number: the input of an upsert."""
    old = chunks(spark, d, "id", "file_path", "chunk_index", "start_line", "end_line", "file_hash")
    size = old.groupBy("file_path").agg(F.max("chunk_index").alias("last"))
    kept = old.join(size, "file_path").where("chunk_index <= floor(last / 2)").withColumn("file_hash", F.concat(F.lit("new-"), "file_hash"))
    more = size.where("last % 2 = 1").select(F.lit(None).cast("bigint").alias("id"), "file_path", (F.col("last") + 1).alias("chunk_index"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("new-chunk").alias("file_hash"))
    return kept.select(old.columns).unionByName(more)


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    old = chunks(spark, d, "id", "file_path", "chunk_index", "start_line", "end_line", "file_hash")
    out = maintain.upsert_chunks(old, _rewritten(spark, d))
    top = F.broadcast(old.agg(F.max("id").alias("top")))
    # Which file gets which new id is not fixed; `upsert_new_ids` shows that they are new, unique and without gaps.
    return out.crossJoin(top).select(F.when(F.col("id") <= F.col("top"), F.col("id")).alias("id"), "file_path", "chunk_index", "file_hash")


def upsert_new_ids(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks are new, how many ids they have, and the first and last of these counted from the largest id before."""
    old = chunks(spark, d, "id", "file_path", "chunk_index", "start_line", "end_line", "file_hash")
    top = F.broadcast(old.agg(F.max("id").alias("top")))
    new = maintain.upsert_chunks(old, _rewritten(spark, d)).crossJoin(top).where("id > top")
    return new.agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("ids"), F.min(F.col("id") - F.col("top")).alias("first"), F.max(F.col("id") - F.col("top")).alias("last"))


def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    old = chunks(spark, d, "id", "file_path", "chunk_index")
    new = old.join(old.groupBy("file_path").agg(F.max("chunk_index").alias("last")), "file_path").where("chunk_index <= floor(last / 2)")
    return maintain.orphan_chunks(old, new)


def sync_progress(spark: SparkSession, d: str) -> DataFrame:
    return status.sync_progress(table(spark, d, "sync_state")).select(F.to_json("progress").alias("progress"))


def cleared_progress(spark: SparkSession, d: str) -> DataFrame:
    return status.clear_progress(table(spark, d, "sync_state"))


def health_check(spark: SparkSession, d: str) -> DataFrame:
    return status.health(table(spark, d, "chunks").select("file_path"), table(spark, d, "sync_state"), 64)


def status_sentence(spark: SparkSession, d: str) -> DataFrame:
    return status.status_sentence(chunks(spark, d, "id", "file_path"), table(spark, d, "sync_state"), 64)


def overview(spark: SparkSession, d: str) -> DataFrame:
    """The nested report, each of its parts as JSON."""
    stored = chunks(spark, d, "id", "file_path", "chunk_text")
    files = stored.groupBy("file_path").agg(F.sum(F.octet_length("chunk_text")).alias("size_bytes"))
    o = status.overview(stored, table(spark, d, "sync_state"), files, _eligible(), C.summary(C.DEFAULTS, "/index"), 0, "/index")
    keep = {"ignoreNullFields": "false"}
    return o.select(F.to_json("index", keep).alias("index"), F.to_json("sync", keep).alias("sync"), F.to_json("config", keep).alias("config"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    e = C.DEFAULTS["embedding"]
    return status.index_status(chunks(spark, d, "id", "file_path"), table(spark, d, "sync_state"), e["model"], e["api_base"], "/index")


def config_summary(spark: SparkSession, d: str) -> DataFrame:
    """The settings a report shows, for each preset and for one of the user's own."""
    rows = []
    for name in [*C.PROVIDERS, None]:
        own = dict(zip(C.PROVIDER_KEYS, C.PROVIDERS[name], strict=True)) if name else {"model": "own-model"}
        rows += [(name or "own", k, str(v)) for k, v in C.summary(C.merge(C.DEFAULTS, {"embedding": own}), "/index").items()]
    return spark.createDataFrame(rows, "preset string, key string, value string")


_HOME = "/root/work/team"


def blacklist_check(spark: SparkSession, d: str) -> DataFrame:
    """Folders of the indexed files under a home folder, barred or not."""
    folder = F.concat(F.lit("/root/work/"), F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/"))
    known = table(spark, d, "chunks").select(folder.alias("path")).distinct()
    fixed = spark.createDataFrame([("/",), ("/root",), ("/root/work",), (_HOME,), ("/root/other",)], "path string")
    paths = known.union(fixed).distinct()
    return paths.select("path", is_blacklisted(F.col("path"), ["/root/work/docs/ui", "/root/work/src/core"], ["/root/work/src"], F.lit(_HOME)).alias("barred"))


def whitelist_paths(spark: SparkSession, d: str) -> DataFrame:
    """Indexed files that lie under the folders that documents of one repo name."""
    files = table(spark, d, "chunks").select(F.concat(F.lit("/"), "file_path").alias("path")).distinct()
    allowed = table(spark, d, "documents").where("file_path is not null").select(F.concat(F.lit("/"), F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)).alias("entry")).distinct()
    return whitelisted_paths(files, allowed)


def ancestor_paths(spark: SparkSession, d: str) -> DataFrame:
    folder = F.concat(F.lit("/"), F.regexp_extract("file_path", "^(.*)/[^/]*$", 1))
    return table(spark, d, "chunks").select(folder.alias("home")).distinct().select("home", F.explode(ancestors(F.col("home"))).alias("path"))


def provider_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = [(*(v[0], v[1], v[3]), k) for k, v in C.PROVIDERS.items()] + [("http://localhost:1/v1", "nomic-embed-text", 768, "none"), ("https://api.openai.com/v1", "text-embedding-3-small", 64, "none")]
    return C.detect_provider(spark.createDataFrame(rows, "api_base string, model string, dimensions int, wanted string")).select("api_base", "model", "dimensions", "provider")


def config_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.sources_table(spark, {"search": {"top_k": 25, "hybrid": {"debug": True}}, "disabled_tools": ["config"]})


def _debounced(spark: SparkSession, d: str, gap: int) -> DataFrame:
    return maintain.debounced(table(spark, d, "events"), gap)


def gc_debounce(spark: SparkSession, d: str) -> DataFrame:
    return _debounced(spark, d, 60_000)


def gc_debounce_day(spark: SparkSession, d: str) -> DataFrame:
    return _debounced(spark, d, 86_400_000)


def event_routing(spark: SparkSession, d: str) -> DataFrame:
    """Events as host events: sign-ups open a session, views and clicks edit a file under one of two names."""
    from lodeseek.streaming.edits import route

    kind = F.when(F.col("event_type") == "signup", "session.created").when(F.col("event_type").isin("view", "click", "error"), "file.edited").otherwise("other")
    name = F.concat(F.lit("u"), "user_id")
    props = F.when(F.col("event_type") == "view", F.create_map(F.lit("filePath"), name)).when(F.col("event_type") == "click", F.create_map(F.lit("file"), name)).otherwise(F.create_map(F.lit("x"), name))
    e = table(spark, d, "events").select("event_id", kind.alias("type"), props.alias("properties"))
    return route(e).select("event_id", "action", "file_path")


def stream_latest_edit(spark: SparkSession, d: str) -> DataFrame:
    """The last edit of each file, by a stream of the event table: each micro-batch adds its own last edits, of which the last one counts."""
    from lodeseek.session import session_path
    from lodeseek.streaming.edits import latest_edits

    own = session_path(spark, "stream")
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    edits = raw.where("event_type in ('view', 'click')").select(F.concat(F.lit("u"), "user_id").alias("file_path"), F.col("event_id").alias("content_version"))

    def batch(rows: DataFrame, number: int) -> None:
        latest_edits(rows).write.mode("overwrite").parquet(f"{own}/batch={number}")

    edits.writeStream.foreachBatch(batch).option("checkpointLocation", f"{own}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest_edits(spark.read.schema(edits.schema).option("recursiveFileLookup", "true").parquet(own))


def vector_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive vectors of the embedding table compared by the built-in expression."""
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


QUERIES = {
    f.__name__: f
    for f in (eligible_files, file_hashes, syntax_chunks, fixed_chunks, hybrid_chunk_dispatch, file_type_multiplier, path_parts, grep_redirect, index_stats, file_stats, extension_counts, coverage_report, changed_files, gc_candidates, listing_union, upsert_chunks, upsert_new_ids, orphan_chunks, sync_progress, cleared_progress, health_check, status_sentence, overview, index_status, config_summary, blacklist_check, whitelist_paths, ancestor_paths, provider_detect, config_sources, gc_debounce, gc_debounce_day, event_routing, stream_latest_edit, vector_cosine_pairs)
}


# SQL


def _any(patterns: list[str], path: str = "file_path") -> str:
    """A list of globs as SQL; the expressions have no lookahead, so a segment after a folder is written as a non-dot first sign."""
    out = []
    for p in patterns:
        if p.startswith("**/*."):
            out.append(f"(regexp_matches({path}, '^([^/.][^/]*/)*[^/.][^/]*\\.{p[5:]}$'))")
        elif p.endswith("/**"):
            folder = p[:-3].replace(".", "\\.")
            out.append(f"regexp_matches({path}, '^{folder}/([^/.][^/]*(/[^/.][^/]*)*)?$')")
        else:
            out.append(f"regexp_matches({path}, '^[^/.][^/]*{p[1:].replace('.', chr(92) + '.')}$')")
    return "(" + " or ".join(out) + ")"


_ELIGIBLE = f"{_any(_INDEXING['include'])} and not {_any(_INDEXING['exclude'])} and not {_any(IGNORED)} and size_bytes <= 512000"
_SOURCE = "replace(replace(lower(trim(source)), '-', '_'), ' ', '_')"
_DOCS = f"docs as (select doc_id, coalesce(file_path, 'notes/' || coalesce({_SOURCE}, 'none') || '/d' || doc_id || '.md') file_path, text from documents)"
_LISTING = f"{_DOCS}, listing as (select file_path, arg_max(text, doc_id) as content from docs group by file_path)"
_STORED = "stored as (select file_path, sum(octet_length(encode(chunk_text))) size_bytes from (select distinct id, file_path, chunk_text from chunks) group by file_path)"
_EXT = "regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)"
_CURRENT = r"cur as (select regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') as file_path, lower(arg_max(file_hash, (logged_at, run_no, outcome))) as content_hash from (select distinct * from indexed_files) group by 1)"


def _begins() -> str:
    cases = " ".join(f"when '{e}' then regexp_matches(line, '{p}')" for e, p in BOUNDARIES.items())
    return f"(case {_EXT} {cases} else false end)"


_SYNTAX = f"""
lines as (select doc_id, file_path, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) n from docs),
marked as (select *, max(n) over (partition by doc_id) last, {_begins()} b from lines),
starts as (select doc_id, n s, last, row_number() over w - 1 k, coalesce(lead(n) over w - 1, last) e, count(*) over (partition by doc_id) m from marked where b window w as (partition by doc_id order by n)),
syn as (select doc_id, cast(k as integer) chunk_index, cast(s as integer) start_line, cast(e as integer) end_line, array_to_string(string_split(text, chr(10))[s:e], chr(10)) body from starts join docs using (doc_id) where m >= 2)"""
_FIXED = """
L as (select doc_id, string_split(text, chr(10)) ls from docs),
P as (select doc_id, ls, len(ls) n, list_transform(range(1, len(ls) + 1), lambda i: list_sum(list_transform(ls[1:i], lambda x: length(x) + 1))) cum from L),
C(doc_id, ci, s, e, n, cum, done) as (
  select doc_id, 0, 1, coalesce(list_min(list_filter(range(1, n + 1), lambda i: cum[i] >= 2048)), n), n, cum, coalesce(list_max(cum), 0) < 2048 from P
  union all
  select doc_id, ci + 1, ns,
    coalesce(list_min(list_filter(range(e + 1, n + 1), lambda i: cum[i] - case when ns = 1 then 0 else cum[ns - 1] end >= 2048)), n), n, cum,
    coalesce(list_min(list_filter(range(e + 1, n + 1), lambda i: cum[i] - case when ns = 1 then 0 else cum[ns - 1] end >= 2048)), 0) = 0
  from (select *, greatest(s, coalesce(list_max(list_filter(range(1, e + 1), lambda j: cum[e] - case when j = 1 then 0 else cum[j - 1] end >= 200)), 1)) ns from C where not done)),
fix as (select doc_id, cast(ci as integer) chunk_index, cast(s as integer) start_line, cast(e as integer) end_line, array_to_string(ls[s:e], chr(10)) body from C join P using (doc_id))"""
_OUT = "doc_id, chunk_index, start_line, end_line, cast(length(body) as integer) as chars, md5(body) as text_md5"


def _debounce_sql(gap: int) -> str:
    return f"""
with recursive e as (select user_id, event_id, epoch_ms(ts) ms, row_number() over (partition by user_id order by epoch_ms(ts), event_id) r from events),
f as (select user_id, event_id, r, ms as last, true as ok from e where r = 1
  union all select e.user_id, e.event_id, e.r, case when e.ms - f.last >= {gap} then e.ms else f.last end, e.ms - f.last >= {gap} from f join e on e.user_id = f.user_id and e.r = f.r + 1)
select user_id, event_id from f where ok"""


_GREP = r"""
with q as (select query_id, unnest([query_text, query_text || '(.*)', string_split(query_text, ' ')[-1], 'src/' || query_text, 'TODO ' || query_text]) pattern,
  coalesce(case when query_id % 3 = 0 then 'src/' when query_id % 3 = 1 then 'src/a.ts' end, '') path, coalesce(case when query_id % 4 = 0 then 'count' end, 'files_with_matches') mode from search_queries where query_text is not null)
select distinct query_id, pattern, not (length(pattern) < 4 or regexp_matches(replace(pattern, '\.', ''), '[*+?\[\]{}()|\\^$]')
  or (path <> '' and not path like '%/' and regexp_matches(path, '(?i)\.[a-z0-9]+$')) or mode in ('count', 'content')
  or regexp_matches(pattern, '[A-Za-z0-9_]\.[A-Za-z0-9_]') or regexp_matches(pattern, '[/\\]') or regexp_matches(pattern, '^["'']|["'']$')
  or regexp_matches(pattern, '^[@#]|TODO|FIXME|HACK|XXX|DEPRECATED') or regexp_matches(pattern, ':/{2}|localhost')) as redirect from q"""

_ANCESTORS = "['/'] || list_transform(range(1, len(list_filter(string_split({x}, '/'), lambda p: p <> '')) + 1), lambda n: '/' || array_to_string(list_filter(string_split({x}, '/'), lambda p: p <> '')[1:n], '/'))"
_OLD = "old as (select distinct id, file_path, chunk_index, start_line, end_line, file_hash from chunks), size as (select file_path, max(chunk_index) as last from old group by file_path)"


def _config_values() -> str:
    import json

    user = {"search": {"top_k": 25, "hybrid": {"debug": True}}, "disabled_tools": ["config"]}
    own = dict(C.flatten(user))
    q = lambda x: json.dumps(x).replace("'", "''")
    rows = ", ".join(f"('{k}', '{q(v)}', {'null' if k not in own else chr(39) + q(own[k]) + chr(39)})" for k, v in C.flatten(C.DEFAULTS))
    return f"select key, coalesce(u, d) as value, case when u is null then 'default' else 'user' end as source from (values {rows}) t(key, d, u)"


def _provider_values() -> str:
    rows = [f"('{v[0]}', '{v[1]}', {v[3]}, '{k}')" for k, v in C.PROVIDERS.items()] + ["('http://localhost:1/v1', 'nomic-embed-text', 768, 'custom')", "('https://api.openai.com/v1', 'text-embedding-3-small', 64, 'custom')"]
    return f"select * from (values {', '.join(rows)}) t(api_base, model, dimensions, provider)"


_MULT = """case when regexp_extract(lower(file_path), '([^/]*)$', 1) = 'readme.md' then 0.5 when lower(file_path) like '%.md' then 0.7
  when regexp_matches(lower(file_path), '\\.(test|spec)\\.[^.]+$') or regexp_matches(lower(file_path), '__(tests|test)__') or contains(lower(file_path), '/test/') then 0.85
  when regexp_matches(lower(file_path), '\\.(json|ya?ml|toml|ini|cfg|conf)$') or starts_with(regexp_extract(lower(file_path), '([^/]*)$', 1), '.') then 0.8 else 1.0 end"""

SQL = {
    "eligible_files": f"with {_LISTING}, {_STORED}, a as (select file_path, octet_length(encode(content)) size_bytes from listing union all select * from stored) select file_path, cast(size_bytes as bigint) as size_bytes from a where {_ELIGIBLE}",
    "file_hashes": f"with {_LISTING} select file_path, sha256(content) as content_hash from listing",
    "syntax_chunks": f"with {_DOCS}, {_SYNTAX} select {_OUT} from syn",
    "fixed_chunks": f"with recursive {_DOCS}, {_FIXED} select {_OUT} from fix",
    "hybrid_chunk_dispatch": f"with recursive {_DOCS}, {_SYNTAX}, {_FIXED} select {_OUT} from (select * from syn union all select * from fix where doc_id not in (select doc_id from syn))",
    "file_type_multiplier": f"select distinct file_path, cast({_MULT} as double) as multiplier from chunks",
    "path_parts": f"select distinct file_path, regexp_extract(file_path, '([^/]*)$', 1) as base, {_EXT} as extension from chunks",
    "grep_redirect": _GREP,
    "index_stats": "select count(distinct file_path) as files, count(*) as chunks, floor(count(*) / count(distinct file_path) * 10 + 0.5) / 10 as avg_chunks_per_file from (select distinct id, file_path from chunks)",
    "file_stats": "select file_path, count(*) as chunks, max(updated_at) as last_updated from (select distinct id, file_path, updated_at from chunks) group by file_path",
    "extension_counts": f"select case when e = '' then '(none)' else e end as extension, count(*) as files from (select distinct file_path, {_EXT} e from chunks) group by 1",
    "coverage_report": f"with {_STORED}, s as (select count(*) files, count(*) filter ({_ELIGIBLE}) eligible from stored) select files, eligible, floor(files / eligible * 100 + 0.5) as coverage_percent from s",
    "changed_files": f"with {_CURRENT}, st as (select file_path, arg_min(file_hash, (chunk_index, id)) stored_hash from (select distinct id, file_path, chunk_index, file_hash from chunks) group by file_path) select cur.file_path, content_hash, stored_hash, case when stored_hash is null then 'new' else 'changed' end as state from cur left join st using (file_path) where content_hash is distinct from stored_hash",
    "gc_candidates": f"with {_CURRENT} select file_path, count(*) as chunks from (select distinct id, file_path from chunks) where file_path not in (select file_path from cur) group by file_path",
    "listing_union": f"with {_CURRENT}, {_DOCS} select file_path from chunks union select file_path from cur union select file_path from docs",
    "upsert_chunks": f"with {_OLD} select id, file_path, chunk_index, case when chunk_index <= floor(last / 2) then 'new-' || file_hash else file_hash end as file_hash from old join size using (file_path) union all select null, file_path, last + 1, 'new-chunk' from size where last % 2 = 1",
    "orphan_chunks": f"with {_OLD} select id, file_path, chunk_index from old join size using (file_path) where chunk_index > floor(last / 2)",
    "sync_progress": "select '{' || string_agg('\"' || key || '\":\"' || replace(value, '\"', '\\\"') || '\"', ',' order by key) || '}' as progress from sync_state where key like 'sync_%'",
    "cleared_progress": "select key, value from sync_state where key not in ('sync_status', 'sync_started_at', 'sync_total_files', 'sync_completed_files', 'sync_current_file', 'sync_error')",
    "health_check": "with s as (select coalesce(max(value) filter (key = 'sync_status'), 'idle') status, coalesce(try_cast(max(value) filter (key = 'embedding_dimensions') as integer) <> 64, false) dimension_mismatch from sync_state), f as (select count(distinct file_path) files from chunks) select files, status, dimension_mismatch, files > 0 and status <> 'error' and not dimension_mismatch as healthy from f, s",
    "status_sentence": "with s as (select coalesce(max(value) filter (key = 'sync_status'), 'idle') status, coalesce(try_cast(max(value) filter (key = 'embedding_dimensions') as integer) <> 64, false) other from sync_state), f as (select count(distinct file_path) files, count(distinct id) chunks from chunks) select case when files = 0 then 'No index yet; the next session makes one.' when status = 'error' or other then 'The index can''t be used; search by text and rebuild it if need be.' else 'Hybrid search is on (' || files || ' files, ' || chunks || ' chunks); ask it before searching by text.' end as sentence from f, s",
    "upsert_new_ids": f"with {_OLD} select count(*) as chunks, count(*) as ids, 1 as first, count(*) as last from size where last % 2 = 1",
    "overview": f"""with {_STORED}, e as (select count(*) filter ({_ELIGIBLE}) eligible from stored), f as (select count(distinct file_path) files, count(distinct id) chunks from chunks),
x as (select case when e = '' then '(none)' else e end ext, count(*) n from (select distinct file_path, {_EXT} e from chunks) group by 1),
s as (select {", ".join(f"(select value from sync_state where key = '{k}') as {k}" for k in ("sync_status", "sync_total_files", "sync_completed_files", "sync_current_file", "sync_error", "last_sync_time"))})
select '{{"files_indexed":' || files || ',"total_chunks":' || chunks || ',"eligible_files":' || eligible || ',"coverage_percent":' || floor(files / eligible * 100 + 0.5) || ',"avg_chunks_per_file":' || floor(chunks / files * 10 + 0.5) / 10
  || ',"extensions":[' || (select string_agg('{{"ext":"' || ext || '","count":' || n || '}}', ',' order by n desc, ext) from x) || '],"size_bytes":0,"path":"/index"}}' as index,
  '{{"status":"' || coalesce(sync_status, 'idle') || '","total":' || coalesce(try_cast(sync_total_files as integer), 0) || ',"completed":' || coalesce(try_cast(sync_completed_files as integer), 0)
  || ',"current_file":' || coalesce('"' || sync_current_file || '"', 'null') || ',"error":' || coalesce('"' || sync_error || '"', 'null') || ',"last_sync":' || coalesce('"' || last_sync_time || '"', 'null') || '}}' as sync,
  '{{"model":"nomic-embed-text","endpoint":"http://localhost:11434/v1","dimensions":"768","provider":"ollama","provider_description":"Ollama (local)","chunking_strategy":"hybrid","max_tokens_per_chunk":"512","storage_path":"/index"}}' as config
from f, e, s""",
    "index_status": "select count(distinct file_path) as files_indexed, count(distinct id) as total_chunks, (select value from sync_state where key = 'last_sync_time') as last_sync, '/index' as path, 'nomic-embed-text' as embedding_model, 'http://localhost:11434/v1' as embedding_endpoint from chunks",
    "config_summary": """
with p as (select * from (values ('ollama', 'nomic-embed-text', 'http://localhost:11434/v1', '768', 'ollama', 'Ollama (local)'), ('openai', 'text-embedding-3-small', 'https://api.openai.com/v1', '1536', 'openai', 'OpenAI'),
  ('voyage', 'voyage-code-3', 'https://api.voyageai.com/v1', '1024', 'voyage', 'Voyage AI'), ('litellm', 'voyage-code-3', 'http://localhost:4000/v1', '1024', 'litellm', 'LiteLLM proxy (Vertex AI, Bedrock, etc.)'),
  ('own', 'own-model', 'http://localhost:11434/v1', '768', 'custom', 'Custom')) t(preset, model, endpoint, dimensions, provider, provider_description)),
w as (select *, 'hybrid' chunking_strategy, '512' max_tokens_per_chunk, '/index' storage_path from p)
unpivot w on model, endpoint, dimensions, provider, provider_description, chunking_strategy, max_tokens_per_chunk, storage_path into name key value value""",
    "blacklist_check": f"with p as (select distinct '/root/work/' || array_to_string(string_split(file_path, '/')[1:2], '/') path from chunks union select unnest(['/', '/root', '/root/work', '{_HOME}', '/root/other'])) select path, not (path = '/root/work/src' or starts_with(path, '/root/work/src/')) and path in ('/', '/root', '/root/work', '{_HOME}', '/root/work/docs/ui', '/root/work/src/core') as barred from p",
    "whitelist_paths": "with p as (select distinct '/' || file_path path from chunks), w as (select distinct '/' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) entry from documents where file_path is not null) select distinct path from p, w where path = entry or starts_with(path, entry || '/') or entry = '/'",
    "ancestor_paths": "with h as (select distinct '/' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) home from chunks) select home, unnest(" + _ANCESTORS.replace("{x}", "home") + ") as path from h",
    "provider_detect": _provider_values(),
    "config_sources": _config_values(),
    "gc_debounce": _debounce_sql(60_000),
    "gc_debounce_day": _debounce_sql(86_400_000),
    "event_routing": "select event_id, case when event_type = 'signup' then 'sync' else 'reembed' end as action, case when event_type in ('view', 'click') then 'u' || user_id when event_type = 'error' then '' end as file_path from events where event_type in ('signup', 'view', 'click', 'error')",
    "stream_latest_edit": "select 'u' || user_id as file_path, max(event_id) as content_version from events where event_type in ('view', 'click') group by 1",
    "vector_cosine_pairs": "select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
}
