import pytest

from cuefold.llm import lookalike as L
from cuefold.llm.queries import p3_forms

SAME = [
    ("Ｏｎｌｙ　４！", "Only 4!"), ("sé", "sé"), ("sе́", "sé"), ("ﬁn ﬀ", "fin ff"), ("a b c　d", "a b c d"), ("a​b­⁠﻿", "ab"),
    ("Whу оn", "Why on"), ("ΑΒ", "AB"), ("a\r\nb", "a\nb"), ("a\tb", "a b"), ("sœur", "soeur"), ("‮abc", "abc"), ("A️", "A"), ("ї", "ï"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("a b", "a\nb"), ("l", "I"), ("l", "1"), ("rn", "m"), ("a b", "ab"), ("x", "x²"), ("o", "0"), ("a  b", "a b"), ("", "x")]


def canon(spark, texts):
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, k int")
    return {r.k: r.canonical for r in L.with_canonical(df, "text").collect()}


@pytest.mark.parametrize("pairs, alike", [(SAME, True), (DIFFERENT, False)])
def test_pairs(spark, pairs, alike):
    got = canon(spark, [t for p in pairs for t in p])
    for k in range(len(pairs)):
        assert (got[2 * k] == got[2 * k + 1]) is alike, pairs[k]


def test_member_is_deterministic_and_rows_stay(spark):
    texts = ["ｘy", "xy", None, "", "xy", "x​y", "z" * 100_000, "é", "é"]
    got = canon(spark, texts)
    assert len(got) == len(texts)
    assert got[0] == got[1] == got[4] == got[5] == "xy" and got[2] is None and got[3] == "" and got[6] == texts[6]
    assert got[7] == got[8]
    assert canon(spark, []) == {}
    with pytest.raises(ValueError):
        L.with_canonical(spark.createDataFrame([("a", "b")], "text string, canonical string"), "text")


def test_readings(spark):
    rows = [("f", 1, 0, 5, "ab"), ("f", 1, 0, 6, "ａb"), ("f", 1, 0, 6, "ａb"), ("f", 1, 0, 7, "ab"), ("f", 1, 1, 8, "ａb"), ("f", 2, 0, 9, "ab"), ("f", 1, 0, 10, None), ("f", 1, 0, 11, ""), (None, 1, 0, 12, "ab"), ("f", 1, 0, None, "ａｂ")]
    df = spark.createDataFrame(rows, "file string, track int, ord int, id bigint, text string")
    assert {tuple(r) for r in L.alike_readings(df, ["file", "track", "ord"], "id", "text").collect()} == {(5, 6), (6, 7)}
    assert L.alike_readings(df.limit(0), ["file", "track", "ord"], "id", "text").count() == 0


def test_folding(one):
    assert one(lambda c: L.bare(L.mapped(c)), "<i>É ｃａfé</i>{\\an8}, ｎ°5!") == "ecafen5"
    assert one(lambda c: L.bare(L.mapped(c)), " ​\n") is None and one(lambda c: L.bare(L.mapped(c)), None) is None and one(lambda c: L.bare(L.mapped(c)), "...") == ""


def test_forms_cover_readings_and_cues(spark, tmp_path):
    """A reading and a cue that look the same have one form; a text only readings have has one too."""
    for name, texts in (("ocr_result", ["\uff41b", "se\u0301!", None]), ("cue", ["ab"]), ("ref_cue", ["ab", "s\u00e9!"]), ("cand_cue", ["x"])):
        spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.text: r.canonical for r in p3_forms(spark, str(tmp_path)).collect()}
    assert set(got) == {"\uff41b", "ab", "se\u0301!", "s\u00e9!", "x"}
    assert got["\uff41b"] == got["ab"] == "ab" and got["se\u0301!"] == got["s\u00e9!"]
