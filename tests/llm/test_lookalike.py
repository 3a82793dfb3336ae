from __future__ import annotations

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm.lookalike import fold_array, fold_column, fold_text, lookalike_pairs


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("naïve", "naïve"), ("the", "ｔｈｅ"), ("code", "соde"), ("first", "ﬁrst"), ("a b", "a b"), ("a b", "a b"), ("chunk", "ch​u­nk"), ("Over", "Ονer"),
        ("a-b", "a‑b"), ("a\nb", "a\r\nb"), ("ṩ", "ṩ"), ("각", "각"), ("12", "１２"), ("﻿ab", "ab"), ("ab", "a‍b"), ("カ", "ｶ"),
    ],
)
def test_alike(a, b):
    assert a != b
    assert fold_text(a) == fold_text(b)


@pytest.mark.parametrize(("a", "b"), [("façade", "facade"), ("THE", "the"), ("3", "³"), ("é", "è"), ("👩‍💻", "👩💻"), ("a–b", "a-b"), ("1", "l"), ("O", "0"), ("a b", "ab"), ("a  b", "a b"), ("ñ", "n")])
def test_visibly_different(a, b):
    assert fold_text(a) != fold_text(b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"], max_codepoint=0x2FFFF), max_size=30), max_size=6))
def test_folding_is_stable_and_ignores_canonical_form(texts):
    once = fold_array(pa.array(texts, pa.string())).to_pylist()
    assert fold_array(pa.array(once, pa.string())).to_pylist() == once
    for form in ("NFC", "NFD"):
        other = fold_array(pa.array([unicodedata.normalize(form, t) for t in texts], pa.string())).to_pylist()
        assert [unicodedata.normalize("NFD", x) for x in other] == [unicodedata.normalize("NFD", x) for x in once]


def test_rows_stay_apart_and_nulls_stay():
    a = pa.array(["e", "́a", None, "", "ab"])
    assert fold_array(a).to_pylist() == ["e", "́a", None, "", "ab"]
    assert fold_array(a[1:]).to_pylist() == ["́a", None, "", "ab"]
    assert fold_array(pa.array([], pa.string())).to_pylist() == []


def test_pairs(spark):
    rows = [(1, "code", "x"), (2, "соde", "x"), (2, "соde", "x"), (3, "code", "x"), (4, "Code", None), (5, None, "x"), (None, "cоde", "x"), (6, "", "x"), (7, "", "x"), (8, "x" * 300_000, "x"), (9, "х" + "x" * 299_999, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    got = {tuple(r) for r in lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (8, 9)}
    assert lookalike_pairs(df.limit(0)).count() == 0


def test_fold_column_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "ｘ", "old"), (2, None, "y")], "id int, text string, folded string")
    got = {r.id: (r.text, r.folded) for r in fold_column(df, "text", "folded").collect()}
    assert got == {1: ("ｘ", "x"), 2: (None, None)}


def test_scripts_selectors_and_tags():
    assert fold_text("ᎪᏴ ⲟⲣ ꓐꓲꓡꓡ") == "AB op BILL"
    assert fold_text("x\U000e0041y\ufe01z\U000e0101") == "xyz"
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e007f"
    assert fold_text(f"a{flag}b") == f"a{flag}b"


def test_classes_and_a_large_class(spark, monkeypatch):
    from lodeseek.llm import lookalike

    monkeypatch.setattr(lookalike, "_PART", 4)
    rows = [(k, "pale moon" if k % 3 else "pаle moon", "f", "r") for k in range(30)] + [(100, "other", "f", "r"), (101, "other", "f", "r"), (102, None, "f", "r"), (None, "x", "f", "r"), (100, "other", "f", "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string, raw string")
    got = {r.doc_id: (r.class_id, r.members, r.texts, r.links) for r in lookalike.lookalike_classes(df).collect()}
    assert got[0] == (0, 30, 2, 20) and got[1] == (0, 30, 2, 10) and got[100] == got[101] == (100, 2, 1, 0) and len(got) == 32
    pairs = lookalike.lookalike_pairs(df).collect()
    assert len(pairs) == 200 and sum(x[3] for x in got.values()) == 400
    assert lookalike.lookalike_classes(df.limit(0)).count() == 0
