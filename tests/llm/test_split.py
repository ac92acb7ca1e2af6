import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuefold.llm import split as S
from cuefold.llm.codes import codes, token_spans
from cuefold.llm.tokens import token_count

TOKEN = re.compile(r"\w+|[^\w\s]+")
SCHEMA = "doc_id bigint, text string, piece int, ident string"


def pieces(spark, texts, limit=8, overlap=3):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in S.split_oversized(df, "doc_id", "text", limit, overlap).orderBy("doc_id", "piece").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def check(text, rows, limit, overlap):
    whole = TOKEN.findall(text)
    assert len(rows) >= 1 + -(-(len(whole) - limit) // (limit - overlap))
    at = 0
    for k, r in enumerate(rows):
        mine = TOKEN.findall(r.text)
        assert len(mine) == r.tokens <= limit
        before = TOKEN.findall(rows[k - 1].text) if k else []
        assert mine[: r.repeated] == before[len(before) - r.repeated :] if r.repeated else True
        assert r.repeated == (min(overlap, len(before)) if k else 0)
        assert whole[at : at + len(mine) - r.repeated] == mine[r.repeated :]
        at += len(mine) - r.repeated
    assert at == len(whole)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=400), st.integers(2, 40), st.integers(0, 39))
@settings(max_examples=200, deadline=None)
def test_cuts_hold(strength, limit, overlap):
    import numpy as np

    overlap = min(overlap, limit - 1)
    at = S.cuts(np.array(strength, np.int8), limit, overlap)
    stop = [*at[1:], len(strength)]
    assert at[0] == 0
    for k, (a, b) in enumerate(zip(at, stop, strict=True)):
        assert a < b and b - a + (overlap if k else 0) <= limit


@given(st.text(alphabet="ab é1_.,!\n\t 　-あ", max_size=200))
@settings(max_examples=200, deadline=None)
def test_tokens(text):
    c = codes(text)
    starts, ends = token_spans(c)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == TOKEN.findall(text)


def test_texts(spark):
    srt = "\n\n".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\nline {k} is here" for k in range(30))
    prose = " ".join(f"word{k}." if k % 7 == 0 else f"word{k}" for k in range(300))
    texts = [srt, prose, "x" * 5000, "a-" * 300, "one two", "", None, "para one two three four five\n\npara six seven eight nine ten", prose.replace(" ", "\r\n")]
    got = pieces(spark, texts, 40, 5)
    assert set(got) == {0, 1, 3, 8}
    for k, rows in got.items():
        check(texts[k], rows, 40, 5)
    wide = pieces(spark, texts, 120, 5)
    check(srt, wide[0], 120, 5)
    assert {r.boundary for r in wide[0]} == {"cue"} and {r.boundary for r in got[1]} <= {"cue", "sentence", "word"} and "inside" in {r.boundary for r in got[3]}
    short = pieces(spark, texts, 8, 2)
    assert short[7][1].boundary == "paragraph"
    for k, rows in short.items():
        check(texts[k], rows, 8, 2)


def test_edges(spark):
    assert pieces(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        S.split_oversized(df, "doc_id", "text", 3, 3)
    rows = pieces(spark, ["a b c d"], 2, 1)[0]
    check("a b c d", rows, 2, 1)


def test_token_count(spark):
    texts = ["it's 3.5 — ok so", "", None, "été_1!?", "あ い"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(token_count(df.t).alias("n")).collect()] == [len(TOKEN.findall(t or "")) for t in texts]
