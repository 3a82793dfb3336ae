from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    p = split_text(text, limit, overlap)
    assert p[0].begin == 0 and p[-1].end == len(text)
    for x in p:
        assert x.end - x.begin <= limit
        assert x.first_line == text.count("\n", 0, x.begin)
        assert x.last_line == text.count("\n", 0, max(x.end - 1, 0))
    for a, b in zip(p, p[1:], strict=False):
        assert a.begin < b.begin < a.end < b.end
        assert overlap // 2 <= a.end - b.begin <= overlap + overlap // 2 + 1
    return p


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n;{}\r", max_size=900), st.integers(40, 120))
def test_pieces_cover_and_overlap(text, limit):
    check(text, limit, 10)


def test_natural_boundaries_come_first():
    text = "\n".join(f"line {k} of the file" for k in range(400))
    for p in check(text, 2048, 200)[:-1]:
        assert text[p.end - 1] == "\n"
    prose = "A sentence of words here. " * 200
    for p in check(prose, 2048, 200)[:-1]:
        assert prose[p.end - 2] == "."


def test_hard_cut_keeps_signs_whole():
    for unit in ("é", "\r\n", "👍🏽"):
        text = "x" + unit * 2000
        for p in split_text(text, 300, 40)[:-1]:
            assert text[p.end] not in "́\n🏽"


def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, file_path string, chunk_index int, chunk_text string, start_line int, piece string, block string, place string, old string")


def test_table(spark):
    long = "\n".join(f"row {k}" for k in range(900))
    big = "word " * 60_000
    e = ("p",) * 4
    data = [(1, "a", 0, "short\ntext\n", 5, *e), (1, "a", 0, "short\ntext\n", 5, *e), (2, "a", 1, long, 7, *e), (2, "a", 1, long, 7, *e), (3, "a", 2, "", 900, *e), (4, "b", 0, None, 1, *e), (5, "b", None, "tail", None, *e), (6, None, 3, "no path", 1, *e), (None, "a", 4, "no id", 1, *e), (7, "c", 0, big, 1, *e)]
    got = sorted(split_oversized(rows(spark, data)).collect(), key=lambda r: (r.file_path or "", r.chunk_index))
    a = [r for r in got if r.file_path == "a"]
    assert [r.chunk_index for r in a] == list(range(len(a)))
    assert (a[0].start_line, a[0].end_line, a[0].pieces) == (5, 6, 1)
    assert a[1].start_line == 7 and a[-2].end_line == 906 and a[-1].chunk_text == "" and {r.id for r in a} == {1, 2, 3}
    assert [(r.id, r.chunk_text) for r in got if r.file_path == "b"] == [(4, None), (5, "tail")]
    assert [r.start_line for r in got if r.id == 5] == [None]
    assert len([r for r in got if r.id == 7]) > 100 and max(len(r.chunk_text) for r in got if r.chunk_text) <= 2048
    assert split_oversized(rows(spark, [])).count() == 0


def test_numbering_over_blocks(spark):
    e = ("p",) * 4
    data = [(k, "hot", k * 3, "t", 1, *e) for k in range(5000)]
    got = {r.id: r.chunk_index for r in split_oversized(rows(spark, data)).select("id", "chunk_index").collect()}
    assert got == {k: k for k in range(5000)}


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError, match="overlap"):
        split_oversized(rows(spark, []), limit=100, overlap=60)


def test_tokens_as_the_unit(spark):
    from lodeseek.llm.splitting import token_ends
    from lodeseek.llm.vocabulary import DEFAULT, encoding

    with open(DEFAULT, "rb") as f:
        enc = encoding(f.read())
    text = "".join(f"line {k} has über some words, and a déjà vu.\n" for k in range(80))
    ends = token_ends(text, enc)
    assert ends[-1] == len(text) and (ends[1:] >= ends[:-1]).all()
    pieces = split_text(text, 100, 20, ends)
    assert pieces[0].begin == 0 and pieces[-1].end == len(text) and len(pieces) > 5
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a.begin < b.begin < a.end < b.end
    count = lambda p: ((ends > p.begin) & (ends <= p.end)).sum()
    assert max(map(count, pieces)) <= 100
    df = spark.createDataFrame([(1, "a", 0, text, 1), (2, "a", 1, "short", 90), (3, "a", None, None, None)], "id bigint, file_path string, chunk_index int, chunk_text string, start_line int")
    got = split_oversized(df, limit=100, overlap=20, vocabulary=DEFAULT).collect()
    assert sum(r.id == 1 for r in got) == len(pieces) and sorted(r.chunk_index for r in got) == list(range(len(got)))
