from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeseek import config as C
from lodeseek.embedding import EmbedderError, HashEmbedder, HttpEmbedder
from lodeseek.engine import DimensionError, Engine
from lodeseek.safety import SafetyLists, home_ancestors
from lodeseek import tools
from lodeseek.sources import corpora, markdown
from lodeseek.sources.warehouse import WarehouseError
from lodeseek.streaming.edits import apply_edits, debounced_stream, route


def files(spark, pairs):
    df = spark.createDataFrame(pairs, "file_path string, content string")
    return df.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def test_index_and_search(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), buckets=4)
    first = files(spark, [("src/auth.ts", "export function signInWithGoogle() {\n  return user_auth\n}\nclass Other {\n}"), ("README.md", "uses signInWithGoogle"), ("dist/x.ts", "function no() {}"), ("old.py", "def gone(): pass")])
    assert e.sync(first)["indexed_files"] == 3
    second = files(spark, [("src/auth.ts", "export function signInWithGoogle() {\n  return user_auth\n}"), ("README.md", "uses signInWithGoogle")])
    assert e.sync(second)["indexed_files"] == 1
    chunks = e.warehouse.read("chunks").collect()
    assert {(r.file_path, r.chunk_index) for r in chunks} == {("src/auth.ts", 0), ("README.md", 0)} and len({r.id for r in chunks}) == 2
    q = spark.createDataFrame([(1, "signInWithGoogle function")], "query_id bigint, query_text string")
    assert e.search(q, threshold=0.0).orderBy("place").first().file_path == "src/auth.ts"
    assert e.search(q, threshold=0.0, path="readme").first().file_path == "README.md"
    assert e.health().first().healthy and e.status().first().files_indexed == 2 and e.overview(second).first()["index"].files_indexed == 2
    assert e.reembed(second) == "unchanged" and e.reembed(files(spark, [("x.bin", "a")])) == "skipped"
    assert e.reembed(files(spark, [("README.md", "other words")])) == "reembedded"
    assert e.collect_garbage(second.where("file_path <> 'README.md'"), 100_000) == "removed:1" and e.collect_garbage(second, 120_000) == "debounced"

    class Broken(HashEmbedder):
        def embed(self, texts):
            if texts == ["ping"]:
                return super().embed(texts)
            raise ValueError("no")  # in a worker, after a good ping

    class Down(HashEmbedder):
        def embed(self, texts):
            raise EmbedderError("no")

    for broken in (Broken(), Down()):
        e.embedder = broken
        found = e.matches(q).first()
        assert "FTS-only" in found.note and found.similarity == "0.000" and found.file == "src/auth.ts" and found.lines == "1-3"
    assert e.sync(second)["outcome"] == "embedder-unreachable" and e.warehouse.state()["sync_error"] and not e.health().first().healthy
    e.embedder = HashEmbedder()
    assert e.sync(second)["outcome"] == "ok" and "sync_error" not in e.warehouse.state()
    e.embedder = HashEmbedder(8)
    assert e.sync(second)["outcome"] == "dimension-mismatch" and e.reindex(second)["outcome"] == "ok"
    e.embedder = HashEmbedder()
    with pytest.raises(DimensionError):
        e.search(q)


def test_stream_of_edits(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), buckets=4)
    e.sync(files(spark, [("a.py", "x = 1"), ("b.py", "y = 1")]))
    edits = spark.createDataFrame([("a.py", "x = 2", 1), ("a.py", "x = 3", 2)], "file_path string, content string, content_version bigint")
    edits.write.parquet(str(tmp_path / "edits"))
    stream = spark.readStream.schema(edits.schema).parquet(str(tmp_path / "edits"))
    apply_edits(stream, e.warehouse, e.index_files, str(tmp_path / "cp")).awaitTermination(90)
    assert {r.file_path: r.chunk_text for r in e.warehouse.read("chunks").collect()} == {"a.py": "x = 3", "b.py": "y = 1"}


def test_routing(spark):
    ev = spark.createDataFrame([("session.created", {}), ("file.edited", {"filePath": "a"}), ("file.edited", {"file": "b"}), ("file.edited", {}), ("other", {})], "type string, properties map<string,string>")
    assert [(r.action, r.file_path) for r in route(ev).collect()] == [("sync", None), ("reembed", "a"), ("reembed", "b"), ("reembed", "")]


def test_debounce_stream_equals_batch(spark, tmp_path, sf):
    from lodeseek.operators.maintain import debounced

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ev = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    (tmp_path / "e").mkdir()
    ev.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))
    q = debounced_stream(stream, 86_400_000).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("debounced").select("user_id", "event_id").collect()}
    assert got == {(r.user_id, r.event_id) for r in debounced(ev, 86_400_000).collect()} and len(got) == 313


def test_config(tmp_path):
    assert C.merge({"a": 1, "l": [1]}, {"a": 2, "l": [1, 2]}, {"b": {"c": 1}}) == {"a": 2, "l": [1, 2], "b": {"c": 1}}
    (tmp_path / "c.jsonc").write_text('{ // note\n "search": {"top_k": 25,}, /* x */ "disabled_tools": ["a//b"]\n}')
    p = C.ProjectConfig(tmp_path / "c.json")
    assert p.effective["search"]["top_k"] == 25 and p.effective["disabled_tools"] == ["a//b"]
    assert ("search.top_k", 25, "user") in p.show()
    q = C.ProjectConfig(tmp_path / "d.json")
    assert q.set("embedding.dimensions", "64")["dimensions_changed"] and q.set("indexing.include", "a, b")["value"] == ["a", "b"]
    with pytest.raises(C.ConfigError):
        q.set("no.such", "1")
    with pytest.raises(C.ConfigError):
        q.set("search.top_k", "x")
    assert q.provider("openai")["dimensions_changed"] and q.effective["embedding"]["dimensions"] == 1536
    q.reset("embedding")
    assert q.effective["embedding"]["dimensions"] == 768
    q.reset()
    assert json.loads((tmp_path / "d.json").read_text()) == {}


def test_safety(tmp_path):
    assert home_ancestors("/Users/tester") == ["/", "/Users", "/Users/tester"]
    s = SafetyLists(tmp_path / "s.json", "/Users/tester")
    assert s.is_blacklisted("/Users") and not s.is_blacklisted("/Users/tester/project")
    s.add("blacklist", "/x")
    assert s.is_blacklisted("/x") and not s.is_blacklisted("/x/y")
    s.add("whitelist", "/x")
    assert not s.is_blacklisted("/x") and s.is_whitelisted("/x/y")
    s.remove("whitelist", "/x")
    s.clear("blacklist")
    assert s.show("blacklist") == ["/", "/Users", "/Users/tester"]


def test_http_embedder():
    calls = []

    def post(url, body, headers, timeout):
        calls.append(json.loads(body)["input"])
        if len(calls) == 1:
            raise OSError("down")
        return json.dumps({"data": [{"index": i, "embedding": [float(i)]} for i, _ in enumerate(calls[-1])]}).encode()

    e = HttpEmbedder("http://x/v1", "m", 1, batch_size=2, backoff=0, post=post)
    assert e.embed(["a", "b", "c"]) == [[0.0], [1.0], [0.0]] and [len(c) for c in calls] == [2, 2, 1]
    with pytest.raises(EmbedderError):
        HttpEmbedder("http://x", "m", 1, backoff=0, post=lambda *a: b"{}").embed(["a"])


def test_folder_source(spark, tmp_path):
    for p, t in {"src/a.ts": "x", "node_modules/y.js": "y", ".git/z": "z", "src/.hid/q.ts": "q", "b.md": "é"}.items():
        (tmp_path / "r" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / p).write_text(t, "utf-8")
    got = {r.file_path: (r.content, r.size_bytes) for r in corpora.folder_files(spark, str(tmp_path / "r")).collect()}
    assert got == {"src/a.ts": ("x", 1), "b.md": ("é", 2)}
    (tmp_path / "ig").write_text("# c\n\n  *.tmp  \n")
    assert corpora.ignore_patterns(spark, str(tmp_path / "ig")) == ["*.tmp"] and corpora.ignore_patterns(spark, str(tmp_path / "none")) == []


def test_sync_states(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), buckets=4, settings=C.merge(C.DEFAULTS, {"indexing": {"max_files": 2}}))
    three = files(spark, [("a.py", "x = 1"), ("b.py", "y = 1"), ("c.py", "tokens of café running")])
    seen = []
    assert e.sync(three, parts=2, on_progress=seen.append)["indexed_files"] == 2
    assert [s["sync_status"] for s in seen] == ["in_progress"] * 2 and seen[0]["sync_total_files"] == "2" and seen[0]["sync_completed_files"] == "0"
    assert set(e.warehouse.state()) == {"sync_status", "last_sync_time", "embedding_dimensions", "schema_version"} and e.terminate()["status"] == "no_process"
    # What lies beyond the cap keeps its chunks; what is gone from the listing doesn't.
    e.settings = C.DEFAULTS
    assert e.sync(three)["indexed_files"] == 1
    e.settings = C.merge(C.DEFAULTS, {"indexing": {"max_files": 1}})
    assert e.sync(three.where("file_path <> 'b.py'"))["indexed_files"] == 0
    assert {r.file_path for r in e.warehouse.read("chunks").collect()} == {"a.py", "c.py"}
    q = spark.createDataFrame([(1, "token cafe run")], "query_id bigint, query_text string")
    from lodeseek.operators.lexical import bm25

    assert [r.id for r in bm25(e.warehouse.index(), q).collect()] == [r.id for r in e.warehouse.read("chunks").where("file_path = 'c.py'").collect()]
    e.warehouse.commit(values={"sync_status": "in_progress"})
    assert e.terminate()["status"] == "cleaned" and e.warehouse.state()["sync_status"] == "idle"
    e.settings = C.merge(C.DEFAULTS, {"indexing": {"auto_index": False}})
    assert e.sync(three)["outcome"] == "auto-index-disabled"
    e.safety, e.root = SafetyLists(tmp_path / "s.json", "/home/x"), "/home"
    assert e.sync(three, force=True)["outcome"] == "blacklisted"
    e.safety = None
    e.warehouse.commit(values={"schema_version": "1"})
    assert e.warehouse.migrate() and e.warehouse.state()["schema_version"] == "2" and not e.warehouse.migrate()
    # An index that can't be read is an error for readers and is made anew by a sync.
    for f in (tmp_path / "w").glob("snapshot-*"):
        import shutil

        shutil.rmtree(f)
    with pytest.raises(WarehouseError):
        e.warehouse.read("chunks")
    assert e.sync(three, force=True)["recreated"] and e.warehouse.read("chunks").count() == 3


def test_tools_and_hooks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), buckets=4, settings=C.merge(C.DEFAULTS, {"disabled_tools": ["reindex"], "disabled_hooks": ["compact-status"]}))
    listing = files(spark, [("src/auth.ts", "export function signIn() {}")])
    host = tools.Host(e, C.ProjectConfig(tmp_path / "c.json"), SafetyLists(tmp_path / "s.json", "/home/x"), lambda: listing, lambda: 10**6)
    t, h = tools.tools(host), tools.hooks(host)
    assert "reindex" not in t and "search" in t and "session.compacting" not in h
    assert json.loads(t["index"]())["status"] == "no_index" and json.loads(t["status"]())["files_indexed"] == 0
    assert h["session.created"]()["outcome"] == "ok" and json.loads(t["index"]())["index"]["extensions"] == [{"ext": ".ts", "count": 1}]
    found = json.loads(t["search"]("signIn", threshold=0.0))
    assert found[0]["file"] == "src/auth.ts" and found[0]["lines"] == "1-1"
    out = {}
    h["tool.execute.before"]("grep", {"pattern": "authentication flow"}, out)
    assert out["blocked"] and out["metadata"]["redirect"]["suggested_tool"] == "search"
    for args in ({"pattern": "function\\s+\\w+"}, {"pattern": "abc"}):
        out = {}
        h["tool.execute.before"]("grep", args, out)
        assert not out
    assert h["file.edited"]("") is None and h["file.edited"]("src/auth.ts") == "unchanged" and h["tool.execute.after"]("ls") is None and h["tool.execute.after"]("bash") == "removed:0"
    assert json.loads(t["blacklist"]("add", "/y"))["blacklist"][-1] == "/y" and json.loads(t["whitelist"]())["whitelist"] == []
    assert json.loads(t["config"]("set", "search.top_k", "3"))["value"] == 3 and tools.to_tool_output("x") == "x" and tools.to_tool_output({"a": 1}) == '{\n  "a": 1\n}'
    with pytest.raises(ValueError, match="no such action"):
        t["config"]("x")


def test_markdown_and_coverage(spark, tmp_path):
    text = "---\r\nname: helper\nsize: 3\nshare: -1.5\non: true\nquoted: 'x: y'\npermission:\n  edit: deny\n  bash:\n    git: \"ask\"\nafter: 1\nno colon\n---\n\n body \n"
    assert markdown.entry(text, "prompt") == {"name": "helper", "size": 3, "share": -1.5, "on": True, "quoted": "x: y", "permission": {"edit": "deny", "bash": {"git": "ask"}}, "after": 1, "prompt": "body"}
    assert markdown.entry("just text", "template") == {"template": "just text"} and markdown.entry("  ", "x") == {}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text(text)
    (tmp_path / "m" / "b.txt").write_text("x")
    assert set(markdown.folder_entries(spark, str(tmp_path / "m"), "prompt")) == {"a"} and markdown.folder_entries(spark, str(tmp_path / "none"), "x") == {}
    got = markdown.with_bundled({"agent": {"a": 1}, "skills": {"paths": ["p"], "k": 1}}, {"a": 0, "b": 2}, {"c": 3}, ["q", "p"])
    assert got == {"agent": {"a": 1, "b": 2}, "command": {"c": 3}, "skills": {"paths": ["p", "q"], "k": 1}} and markdown.with_bundled({}, {}, {}, []) == {}
    rows = spark.createDataFrame([("x\nAll files | 95.5 | 91 | 3",), ("All files | 95 | 89.9 |",), ("none",)], "text string")
    assert [(r.functions, r.lines, r.enough) for r in markdown.coverage(rows).collect()] == [(95.5, 91.0, True), (95.0, 89.9, False), (None, None, None)]


def test_repository_listing(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "b.py").write_text("1")
    (root / "a.py").write_text("1")
    assert [r.file_path for r in corpora.repository_files(spark, str(root)).orderBy("place").collect()] == ["a.py", "b.py"]
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "b.py")
    git("commit", "-qm", "x", "--date", "2001-01-01T00:00:00Z")
    (root / ".gitignore").write_text("z.py\n")
    (root / "z.py").write_text("1")
    assert [r.file_path for r in corpora.repository_files(spark, str(root)).orderBy("place").collect()] == ["b.py", ".gitignore", "a.py"]
    assert corpora.repository_files(spark, str(root), 2).count() == 2
    (root / "b.py").write_text("2")
    assert {r.file_path for r in corpora.repository_changes(spark, str(root), "2100-01-01T00:00:00Z").collect()} == {"b.py", ".gitignore", "a.py"}
    listed = corpora.folder_files(spark, str(root), max_bytes=1)
    assert {r.file_path for r in listed.collect()} >= {"a.py", "b.py"} and corpora.modified_since(listed, "2100-01-01").count() == 0 and corpora.modified_since(listed, None).count() == listed.count()
