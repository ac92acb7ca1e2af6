import pytest

from cuefold.functions import text as T


@pytest.mark.parametrize("raw, out", [
    ("&amp;lt;b&gt;", "<b>"), ("<I>x</I> <font color='a>b'>y</font>", "<i>x</i> y"), ("a<br/>b<BR>c", "a\nb\nc"), (r"{\an8}up\Ndown\hx", "up\ndown\nx"),
    ("a \t\nb\r\n\n\n\nc", "a\nb\n\nc"), (" ﻿ x 　", "x"), ("", ""), (None, None), ("1 < 2", "1 < 2"), ("<u>", "<u>"),
])
def test_clean_markup(one, raw, out):
    assert one(T.clean_subtitle_text, raw) == out


@pytest.mark.parametrize("raw, out", [
    ("‘Tis", "Tis"), ("|t is", "It is"), ("and | see", "and I see"), ("...| know", "...I know"), ("-Hi", "- Hi"), ("_Hi", "- Hi"), ("f Song", "♪ Song"),
    ("Song J", "Song ♪"), ("|--", ""), ("..-so", "...so"), (".- so", ".- so"), (". so", "...so"), (".. so", "...so"), ("Idoor slams]", "[door slams]"),
    ("door slams]_,", "[door slams]"), ("[door],", "[door]"), ("IDoor Slams1", "[Door Slams]"), ("[door 1", "[door]"), ("OK.", "O..."), ("H..", "H..."), ("a   b", "a b"),
    ("x\r\n\n  y ", "x\ny"), ("", ""),
])
def test_clean_ocr(one, raw, out):
    assert one(T.clean_ocr_text, raw) == out


def test_fitted_cleanup(one):
    fitted = lambda c: T.clean_ocr_text(c, "fitted")
    assert one(fitted, "...| Know it") == "...I know it"
    assert one(fitted, "..-0f course") == "...of course"
    assert one(fitted, "/ want it") == "I want it"
    with pytest.raises(ValueError):
        T.clean_ocr_line(None, "other")


def test_health(one):
    assert one(T.text_health, "the 12 zebra i?s") == pytest.approx((1 + 0.75 + 0.5 + 0) / 4)
    assert one(T.text_health, "...") is None
    assert one(T.text_health, None) is None
    assert one(T.text_health, "you have to go home") > one(T.text_health, "y0u h&ve t0 g0 h#me")


def test_similarity(one):
    assert one(T.similarity, "", "") == 1.0
    assert one(T.similarity, "abcd", "abxd") == 0.75


def test_names(one):
    assert one(T.safe_name, "a b/c!") == "a_b_c"
    assert one(T.safe_upload_name, "/x/..") == "subtitle-file"
    assert one(T.safe_upload_name, "a/b*c .srt") == "b_c .srt"
    assert one(T.local_path, " '/a\\ b' ") == "/a b"
    assert one(T.first_useful_line, "\n  x \ny") == "x"
    assert one(T.last_meaningful_line, "boom\n  at f()\n\n") == "boom"
    assert one(T.version_triple, "tool v5.3") == [5, 3, 0]
    assert one(lambda c: T.below_version(c, "5.3.1"), "v5.3.0") is True
    assert one(lambda c: T.below_version(c, "5.3.1"), "none") is False
