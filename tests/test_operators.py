from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import lexical, maintain, merge, status
from lodeseek.operators.chunking import chunk_files, register_chunk_udtf, spans_by_size
from lodeseek.operators.eligibility import is_blacklisted, redirects_grep, should_index, whitelisted_paths
from lodeseek.operators.fusion import hybrid_search, vector_search, word_search
from lodeseek.operators.vector import vector_top_k

CHUNKS = "id bigint, file_path string, chunk_index int, chunk_text string, start_line int, end_line int, embedding array<float>, file_hash string, identifiers string"
FIVE = [
    (1, "src/auth.ts", "export function signInWithGoogle() {} user_auth tokens", "signInWithGoogle sign In With Google user_auth user auth"),
    (2, "README.md", "This project uses signInWithGoogle. tokens token café cafe authentication", ""),
    (3, "src/db.ts", "database connection running user auth", "db"),
    (4, "a.py", "auth auth auth config", ""),
    (5, "b.py", "nothing here", ""),
]


def spans(content, max_tokens, overlap_tokens):
    lines = content.split("\n")
    return [(k, a, b, "\n".join(lines[a - 1 : b])) for k, a, b in spans_by_size([len(x) for x in lines], 4 * max_tokens, 4 * overlap_tokens)]


def test_fixed_spans():
    assert spans("aaaa\nbbbb\ncccc\ndddd", 2, 1) == [(0, 1, 2, "aaaa\nbbbb"), (1, 2, 3, "bbbb\ncccc"), (2, 3, 4, "cccc\ndddd"), (3, 4, 4, "dddd")]
    assert spans("aaaa\nbbbb\ncccc", 2, 1)[2] == (2, 3, 3, "cccc")
    assert [s[1:3] for s in spans("a\nb\nc\nd\ne\nf", 1, 0)] == [(1, 2), (3, 4), (5, 6)]
    assert spans("", 5, 1) == [(0, 1, 1, "")]


def test_chunk_files(spark):
    ts = "import x\nexport function a() {\n}\nclass B {\n}\n"
    df = spark.createDataFrame([("a.ts", ts, 1), ("b.ts", "const f = () => 1", 2), ("c.txt", "", 3), ("d.ts", None, 4)], "file_path string, content string, chunk_index int")
    got = {(r.file_path, r.chunk_index): (r.chunk_text, r.start_line, r.end_line) for r in chunk_files(df).collect()}
    assert got == {("a.ts", 0): ("export function a() {\n}", 2, 3), ("a.ts", 1): ("class B {\n}\n", 4, 6), ("b.ts", 0): ("const f = () => 1", 1, 1), ("c.txt", 0): ("", 1, 1)}
    assert {r.start_line for r in chunk_files(df, keep_preamble=True).where("file_path = 'a.ts'").collect()} == {1, 2, 4}
    assert chunk_files(df, strategy="fixed").where("file_path = 'a.ts'").count() == 1
    with pytest.raises(ValueError, match="strategy"):
        chunk_files(df, strategy="other")
    register_chunk_udtf(spark)
    assert spark.sql("select t.* from values ('a\nb') v(c), lateral chunk_text(c) t").collect()[0].text == "a\nb"


def test_a_word_ends_before_a_letter_that_is_not_ascii(spark):
    df = spark.createDataFrame([("a.ts", "classé X\nclasses Y\nenum Z\nconst f = (a)\nconst g = ()")], "file_path string, content string")
    assert [(r.start_line, r.end_line) for r in chunk_files(df).orderBy("chunk_index").collect()] == [(1, 2), (3, 3), (4, 5)]


def test_grid_of_queries_equals_broadcast(spark):
    import random

    rng = random.Random(1)
    chunks = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(rng.choice([3, 5]))] if i % 9 else None) for i in range(60)], "id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(rng.choice([3, 5]))]) for i in range(40)], "query_id bigint, query_vector array<float>")
    rows = lambda b: sorted(map(tuple, vector_top_k(chunks, q, 4, block_bytes=b).collect()))
    assert rows(500) == rows(1 << 20) and len(rows(500)) == 160


def five(spark):
    return spark.createDataFrame([(i, p, 0, t, 1, 1, None, "h", ids) for i, p, t, ids in FIVE], CHUNKS)


@pytest.mark.parametrize("match", ["auth", "connection", "cafe", "user_auth tokens"])
def test_bm25_equals_sqlite(spark, match):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, b, c, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, a, b, c) values (?, ?, ?, ?)", FIVE)
    query = " or ".join(f'"{w}"' for w in match.split()).upper().replace("OR", "OR")
    want = dict(con.execute("select rowid, rank from t where t match ?", [query]).fetchall())
    q = spark.createDataFrame([(1, match)], "query_id bigint, query_text string")
    phrases = spark.createDataFrame([(w,) for w in match.split()], "phrase string")
    index = lexical.build_index(five(spark))
    counts = lexical.phrase_counts(index, phrases)
    got = {r.id for r in counts.collect()}
    assert got == set(want)
    if match in ("connection", "cafe"):
        scores = {r.id: r.bm25 for r in lexical.bm25(index, q, "or").collect()}
        assert scores == pytest.approx(want, rel=1e-6)


def test_two_phases(spark):
    q = spark.createDataFrame([(1, "user auth connection"), (2, "user auth nowhere"), (3, "the")], "query_id bigint, query_text string")
    got = {}
    for r in lexical.bm25(lexical.build_index(five(spark)), q).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got[1] == {3} and got[2] >= {1, 3, 4} and 3 not in got


def test_search(spark):
    rows = [(1, "src/auth.ts", 0, "export function signInWithGoogle() {}", 1, 1, [0.9, 0.1, 0.0, 0.0], "h1", "signInWithGoogle"), (2, "README.md", 0, "This project uses signInWithGoogle.", 1, 1, [0.8, 0.2, 0.0, 0.0], "h2", "signInWithGoogle"), (3, "z.ts", 0, "zero", 1, 1, [0.0] * 4, "h3", "")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    q = spark.createDataFrame([(1, "signInWithGoogle function", [0.9, 0.1, 0.0, 0.0])], "query_id bigint, query_text string, query_vector array<float>")
    index = lexical.build_index(chunks)
    assert [r.file_path for r in hybrid_search(chunks, index, q, threshold=0.0).orderBy("place").collect()][:2] == ["src/auth.ts", "README.md"]
    assert {r.note for r in word_search(chunks, index, q).collect()} == {"FTS-only result (embedding server unavailable)"}
    assert [r.id for r in vector_search(chunks, q, 2, 0.35).orderBy("place").collect()] == [1, 2]
    assert {r.id: r.similarity for r in vector_top_k(chunks, q, 5, block_bytes=40).collect()}[3] == 0.0
    assert [r.id for r in vector_top_k(chunks, q, 5, path_prefix=F.col("file_path").ilike("SRC/%")).collect()] == [1]
    assert vector_top_k(chunks, q.limit(0), 5).count() == 0


def test_merge(spark):
    hits = spark.createDataFrame([(1, 1, "a.ts", 1, 10, 0.0, 0.5, "x"), (1, 2, "a.ts", 15, 20, 0.0, 0.7, "y"), (1, 3, "a.ts", 26, 30, 0.0, 0.4, "z"), (1, 4, "b.ts", 1, 5, 0.0, 0.6, "w")], "query_id bigint, id bigint, file_path string, start_line int, end_line int, similarity double, score double, chunk_text string")
    got = [(r.file_path, r.start_line, r.end_line, r.score, r.preview) for r in merge.merge_adjacent(hits).orderBy("place").collect()]
    assert got == [("a.ts", 1, 20, 0.7, "x"), ("b.ts", 1, 5, 0.6, "w"), ("a.ts", 26, 30, 0.4, "z")]


def test_eligibility(spark):
    check = lambda p, size: spark.range(1).select(should_index(F.lit(p), F.lit(size), ["**/*.ts"], ["dist/**"], ["old/**"], 1).alias("x")).first()[0]
    assert [check("a.ts", 10), check("dist/a.ts", 10), check("old\\a.ts", 10), check("a.py", 10), check("a.ts", 1025), check("a.ts", None)] == [True, False, False, False, False, False]
    bad = lambda p, w=(): spark.range(1).select(is_blacklisted(F.lit(p), ["/x"], list(w), F.lit("/Users/tester")).alias("x")).first()[0]
    assert [bad("/Users"), bad("/Users/tester/project"), bad("/x"), bad("/x", ["/x"])] == [True, False, True, False]
    g = lambda p, f=None, m=None: spark.range(1).select(redirects_grep(F.lit(p), F.lit(f).cast("string"), F.lit(m).cast("string")).alias("x")).first()[0]
    assert g("authentication flow") and not any([g(r"function\s+\w+"), g("abc"), g("some text", "a.ts"), g("some text", None, "count"), g("a.b text"), g("a/b text"), g("'quoted"), g("TODO later"), g("localhost now")])
    p = spark.createDataFrame([("/a/b",), ("/ab",), ("/a",)], "path string")
    assert {r.path for r in whitelisted_paths(p, spark.createDataFrame([("/a",)], "entry string")).collect()} == {"/a/b", "/a"}


def small(spark, rows):
    return spark.createDataFrame([(i, p, k, h) for i, p, k, h in rows], "id bigint, file_path string, chunk_index int, file_hash string")


def test_maintenance(spark):
    old = small(spark, [(1, "a", 0, "h1"), (2, "a", 1, "h1"), (3, "b", 0, "h2")])
    new = small(spark, [(None, "a", 0, "h9"), (None, "c", 0, "h3"), (None, "c", 1, "h3")])
    files = spark.createDataFrame([("a", "h1"), ("b", "x"), ("d", None)], "file_path string, content_hash string")
    assert {r.file_path: r.state for r in maintain.changed_files(files, old).collect()} == {"b": "changed"}
    assert {(r.file_path, r.chunks) for r in maintain.gc_candidates(old, files.where("file_path = 'a'")).collect()} == {("b", 1)}
    up = {(r.file_path, r.chunk_index): (r.id, r.file_hash) for r in maintain.upsert_chunks(old, new).collect()}
    assert up["a", 0] == (1, "h9") and up["a", 1] == (2, "h1") and {up["c", 0][0], up["c", 1][0]} == {4, 5}
    assert [r.id for r in maintain.orphan_chunks(old, new).collect()] == [2]
    assert {(r.file_path, r.chunk_index) for r in maintain.replace_files(old, new).collect()} == {("a", 0), ("b", 0), ("c", 0), ("c", 1)}
    assert {r.id for r in maintain.delete_files(old, new).collect()} == {3}
    kv = spark.createDataFrame([("k", 1, "a"), ("m", 2, "b")], "k string, v int, x string")
    assert {(r.k, r.x) for r in maintain.upsert(kv, spark.createDataFrame([("k", 1, "n"), ("m", 1, "n")], kv.schema), ["k"], "v").collect()} == {("k", "n"), ("m", "b")}


def test_status(spark):
    empty = small(spark, [])
    state = spark.createDataFrame([("sync_status", "idle"), ("syncXx", "1"), ("embedding_dimensions", "64")], "key string, value string")
    assert status.index_stats(empty).first()[:] == (0, 0, 0.0)
    assert status.health(small(spark, [(1, "a", 0, "h")]), state, 64).first().healthy is True
    assert status.health(small(spark, [(1, "a", 0, "h")]), state, 32).first().healthy is False
    assert status.sync_progress(state).first()[0] == {"sync_status": "idle", "syncXx": "1"}
    assert status.state_value(status.set_state(state, "sync_status", "error"), "sync_status") == "error"
    assert status.clear_progress(state).count() == 2
    assert status.status_sentence(empty, state, 64).first()[0] == "No index yet; the next session makes one."
    assert status.coverage(empty, spark.createDataFrame([], "file_path string"), F.lit(True)).first().coverage_percent is None


def no_index(*args, **kw):
    raise AssertionError("a word index is built")


def bm25_rows(index, q, mode, **kw):
    return sorted((r.query_id, r.id, round(r.bm25, 9)) for r in lexical.bm25(index, q, mode, **kw).collect())


def asked_of_five(spark):
    return spark.createDataFrame([(1, "user auth connection"), (2, "user_auth token nowhere"), (3, "the"), (4, "auth"), (5, "authentication _ tokens token"), (6, "user auth running")], "query_id bigint, query_text string")


def test_all_words_without_an_index(spark, sf, monkeypatch):
    q, index = asked_of_five(spark), lexical.build_index(five(spark))
    monkeypatch.setattr(lexical, "sorted_postings", no_index)
    scan = lexical.Scan(five(spark).unionByName(five(spark).where("id < 3")))
    assert {r[:2] for r in bm25_rows(scan, q, "and")} == {(1, 3), (6, 3)}
    assert bm25_rows(scan, q, "and") == bm25_rows(index, q, "and")
    from lodeseek.plans import search

    monkeypatch.setattr(search, "word_index", no_index)
    assert search.bm25_and(spark, sf).count() > 0


def test_phrases_without_an_index(spark, sf, monkeypatch):
    from lodeseek.plans import search

    phrases = spark.createDataFrame([("user_auth",), ("auth_tokens",), ("Auth",), ("db_db",), ("a_py",), ("_",)], "phrase string")
    twice = spark.createDataFrame([(7, "x/y.ts", 0, "db db db", 1, 1, None, "h", "db")], CHUNKS).unionByName(five(spark))
    rows = lambda x: sorted(map(tuple, lexical.phrase_counts(x, phrases).collect()))
    want = rows(lexical.build_index(twice))
    assert rows(lexical.Scan(twice.unionByName(twice))) == want and ("db_db", 7, 2, 7) in want
    monkeypatch.setattr(lexical, "PHRASES_AT_ONCE", 2)
    assert rows(lexical.Scan(twice)) == want
    monkeypatch.setattr(search, "word_index", no_index)
    assert search.bm25_phrase(spark, sf).columns == ["phrase", "id", "f"]


def test_hybrid_without_an_index(spark, sf, monkeypatch):
    from lodeseek.plans import search

    monkeypatch.setattr(search, "word_index", no_index)
    assert search.hybrid_search_merged(spark, sf).count() > 0


def test_path_filter_without_an_index(spark, sf, monkeypatch):
    from lodeseek.plans import search

    q, rows = asked_of_five(spark), five(spark)
    own = rows.where("file_path like '%.py' or id = 1")
    assert bm25_rows(lexical.Scan(rows), q, "fallback", within=own) == bm25_rows(lexical.build_index(rows), q, "fallback", within=own) != []
    monkeypatch.setattr(search, "word_index", no_index)
    monkeypatch.setattr(search, "chunks", no_index)
    assert search.bm25_path_filtered(spark, sf).count() > 0


def test_fallback_without_an_index(spark, sf, monkeypatch):
    from lodeseek.plans import search

    q, rows = asked_of_five(spark), five(spark)
    got = bm25_rows(lexical.Scan(rows), q, "fallback")
    assert got == bm25_rows(lexical.build_index(rows), q, "fallback")
    assert {r[:2] for r in got if r[0] in (1, 6)} == {(1, 3), (6, 3)} and {r[1] for r in got if r[0] == 2} >= {1, 3, 4}
    monkeypatch.setattr(search, "word_index", no_index)
    assert search.bm25_and_or_fallback(spark, sf).count() > 0


def test_any_phrase_in_several_searches(spark, sf, monkeypatch):
    from lodeseek.plans import search

    q, rows = asked_of_five(spark), five(spark)
    want = bm25_rows(lexical.build_index(rows), q, "or")
    monkeypatch.setattr(lexical, "PHRASES_AT_ONCE", 4)
    assert bm25_rows(lexical.Scan(rows), q, "or") == want != []
    assert bm25_rows(lexical.Scan(rows.limit(0)), q, "or") == bm25_rows(lexical.Scan(rows), q.limit(0), "or") == []
    monkeypatch.setattr(search, "word_index", no_index)
    assert search.bm25_or(spark, sf).count() > 0


def test_best_matches_are_those_of_all_matches(spark, monkeypatch):
    many = spark.createDataFrame([(5 * k + i, f"{k}/{p}", 0, f"{t} {'auth ' * (k % 3)}", 1, 1, None, "h", ids) for k in range(9) for i, p, t, ids in FIVE], CHUNKS)
    q, index = asked_of_five(spark), lexical.build_index(many)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        every = lexical.bm25(index, q, "fallback", digits=12)
        want = sorted(map(tuple, lexical.best(every, "bm25", 3, True).collect()))
        for x in (index, lexical.Scan(many)):
            assert sorted(map(tuple, lexical.best_bm25(x, q, 3).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0] for r in want} == {1, 2, 4, 5, 6} and len(want) == 15


def test_texts_of_candidates_alone_are_joined(spark, sf, monkeypatch):
    from lodeseek.operators import fusion
    from lodeseek.plans import search

    rows = lambda: sorted(map(tuple, search.search_results(spark, sf).collect()))
    broadcast = rows()
    monkeypatch.setattr(fusion, "BROADCAST_IDS", 0)
    assert rows() == broadcast and broadcast
