from __future__ import annotations

import pytest

from lodeseek.llm.provenance import declares, file_layout, not_hand_written

CODE = "\n".join(f"export function load{k}(input) {{\n  const size = input.map((n) => n.range ?? {k})\n  return {{ size }}\n}}" for k in range(20))
MIN = "(function(e){var t=e.data||[],n=" + ";".join(f"a{k}=t[{k}]&&n(function(r){{return r<{k}?e:t}})" for k in range(80)) + "})();"
DATA = "export const t = [\n" + "\n".join("  " + ", ".join(str((k * 37 + j * 11) % 256) for j in range(18)) + "," for k in range(30)) + "\n]"
B64 = "export const t = [\n" + "\n".join('  "qedDy/G0FOOnrPbE/S2ucqo4j5LgypVOJe0V48B7ya0qcucBjKzig0LSe2wZdMM686uGeUBCcEoh",' for _ in range(20)) + "\n]"
CERT = "-----BEGIN CERTIFICATE-----\n" + "\n".join("MIIDdzCCAl+gAwIBAgIEAgAAuTANBgkqhkiG9w0BAQUFADBaMQswCQYDVQQGEwJ1" for _ in range(20)) + "\n-----END CERTIFICATE-----"


@pytest.mark.parametrize(
    "text",
    ["// Code generated by chunkgen v4.3. DO NOT EDIT.", "/* @generated from chunk.proto */", "# <auto-generated> tool=x </auto-generated>", "-- Produced by chunk-bindgen on build machine; source: x.yaml", "// This file was automatically created by the repo compiler; changes will be lost.",
     "/* Diese Datei wurde automatisch erzeugt (x-Generator). Nicht bearbeiten! */", "# AUTOGENERATED FILE - regenerate with `make x`", "// Vendored from wojijuhi (release 9.25); local changes belong upstream", "/*! Bundled copy of libx 2.19, taken over unchanged from upstream */",
     "# Copyright (c) 2020 the Bisijalo authors. Third-party code, imported at 27cfd97", "/*! samawumi.js v2.1.1 | (c) The Samawumi Project Contributors | MIT License */"],
)
def test_declared(text):
    assert any(declares("x = 1\n" + text + "\ny = 2"))


@pytest.mark.parametrize(
    "text",
    ["// Minified input is skipped by resolveBranch, see the notes.", "# Request ids are generated by the caller and checked in mergeFolder.", "# Do not edit merge_tree while the daemon holds the lock.", "// Copyright (c) our own gateway team. Written and kept by hand.",
     "// Replaces the auto-generated chunk stub that we deleted last year.", "// Upstream sends vector pages; we copy only what resolveWindow wants.", "-- banner: generated by bucketgen, do not edit", 'const banner = "// Code generated by x. DO NOT EDIT."', "// writes the first line of every emitted module"],
)
def test_not_declared(text):
    assert not any(declares("x = 1\n" + text + "\ny = 2"))


def test_files(spark):
    rows = [
        ("src/a.ts", CODE), ("src/b.js", MIN), ("src/c.py", DATA), ("src/d.go", B64), ("src/e.ts", CODE + "\n" + CERT), ("src/f.ts", CODE), ("src/f.ts", "// @generated from x.proto\n" + CODE), ("vendor/x/a.go", CODE), ("src/vendor_portal/a.go", CODE),
        ("web/x.min.js", CODE), ("src/min_x.ts", CODE), ("a/package-lock.json", "{}"), ("a/deps.lock.json", None), ("src/emit_generated_header.go", CODE), ("src/x_pb2.py", CODE), ("src/g.ts", CODE + '\nconst s = "' + "a long line of words in ordinary code " * 60 + '"'),
        ("src/h.ts", CODE + "\n" + "const t = [\n  [207, 121, 2, 10], // quick chunk node\n  [109, 9, 1153, 312], // other\n]"), ("docs/x.md", "# Code generated by x\n" + DATA), ("src/i.ts", "検索結果の順序は安定しており、" * 200), (None, MIN), ("src/j.ts", ""), ("src/k.ts", None), ("src/l.js", MIN * 400), ("web/node_modules/x/i.js", CODE), ("node_modules\\x\\i.js", CODE), ("dist/x.c8187e34.js", CODE),
    ]
    df = spark.createDataFrame([(p, t, "r", "l") for p, t in rows], "file_path string, chunk_text string, reason string, lines string")
    got = {r.file_path: r.reason for r in not_hand_written(df.union(df)).collect()}
    assert got == {"src/b.js": "minified", "src/c.py": "data", "src/d.go": "data", "src/f.ts": "generated", "vendor/x/a.go": "vendored", "web/x.min.js": "minified", "a/package-lock.json": "lock", "a/deps.lock.json": "lock", "src/x_pb2.py": "generated", "src/l.js": "minified", "web/node_modules/x/i.js": "vendored", "node_modules\\x\\i.js": "vendored", "dist/x.c8187e34.js": "minified"}
    assert not_hand_written(df.limit(0)).count() == 0


def test_wrapped_minified_code(spark):
    def wrap(text, width):
        return "\n".join(text[i : i + width] for i in range(0, len(text), width))

    rows = [(f"src/w{n}.js", wrap(MIN * 3, n)) for n in (100, 120, 250)] + [("src/w.go", wrap(MIN.replace(" ", "") * 3, 240))]
    rows += [("src/a.ts", CODE), ("src/long.ts", "\n".join(f"    const value{k} = await loadEverything(input{k}, {{ range: {k}, depth: [1, 2, 3], name: 'value' }}) ?? other" for k in range(60))), ("src/b.go", B64), ("src/w.md", wrap(MIN * 3, 120))]
    got = {r.file_path: r.reason for r in not_hand_written(spark.createDataFrame(rows, "file_path string, chunk_text string")).collect()}
    assert got == {"src/w100.js": "minified", "src/w120.js": "minified", "src/w250.js": "minified", "src/w.go": "minified", "src/b.go": "data"}


def test_layout_alone_and_languages(spark):
    rows = [("src/a.ts", CODE), ("src/b.js", MIN), ("src/c.py", DATA), ("vendor/x/a.go", CODE), ("src/g.ts", "// @generated from x.proto\n" + CODE)]
    # Long tight lines are dense, by their length or as wrapped ones; dense digits are data.
    tight = "\n".join(("a" * 9 + "=(b[1],c);") * 20 for _ in range(4))
    rows += [("src/t.js", tight), ("src/t.py", tight), ("src/n.go", "var x = []int{" + "4711, 815, 1234,\n" * 60 + "}")]
    df = spark.createDataFrame(rows, "file_path string, chunk_text string")
    got = {r.file_path: r.reason for r in not_hand_written(df, by_layout_alone=True).collect()}
    assert got == {"src/b.js": "minified", "src/c.py": "data", "src/t.js": "minified", "src/t.py": "minified", "src/n.go": "data"}
    assert set(got) < {r.file_path for r in not_hand_written(df).collect()}


def test_deliveries_count_once(spark):
    half = "const t = [\n" + "\n".join("  " + ", ".join(str((k * 37 + j * 11) % 256) for j in range(18)) + "," for k in range(9)) + "\n]\n" + CODE[:700]
    df = spark.createDataFrame([("src/h.ts", half)], "file_path string, chunk_text string")
    assert not_hand_written(df).count() == not_hand_written(df.union(df).union(df)).count()
    r = file_layout(df.union(df)).first()
    assert r.chars == len(half) and r.lines == half.count("\n") + (not half.endswith("\n")) and r.digits == sum(c.isdigit() for c in half)
