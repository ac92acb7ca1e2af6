import random

from pyspark.sql import functions as F

from cuefold.llm.runs import collapse_runs

SCHEMA = "file string, ord int, s bigint, e bigint, text string, block int, chain string"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    return a == b or (1 - lev(a, b) / max(len(a), len(b))) >= 0.85


def brute(rows):
    out = []
    for f in {r[0] for r in rows if r[0] is not None}:
        run = None
        for _, o, s, e, t in sorted({r for r in rows if r[0] == f and r[1] is not None}, key=lambda r: r[1]):
            if t is None or not t.strip():
                run = None
                continue
            if run and near(run[-1][2], t):
                run.append((o, (s, e), t))
            else:
                run = [(o, (s, e), t)]
                out.append((f, run))
    return {(f, r[0][0], r[-1][0], len(r), r[0][2]) for f, r in out}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsX", "aXcdefghijklmnopqrsX", "short", "shord", None, " ", "abcdefghijklmnXXXXst"]
    for block in (3, 16, 4096):
        rows = []
        for f in ("hot", "b"):
            o = 0
            for _ in range(150):
                o += rng.choice([1, 1, 1, 2, 9])
                rows.append((f, o, rng.choice([o, None]), o + 1, rng.choice(words[:3] * 3 + words)))
        rows += rows[:30] + [(None, 1, 0, 1, "x"), ("b", None, 0, 1, "x")]
        df = spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA)
        got = {(r.file, r.first, r.last, r.n, r.text) for r in collapse_runs(df, "file", "ord", "text", F.col("s"), F.col("e"), block).collect()}
        want = {(f, a, b, n, t.strip() if False else t) for f, a, b, n, t in brute([(f, o, s, e, t.lower() if t else t) for f, o, s, e, t in rows])}
        assert {(f, a, b, n) for f, a, b, n, _ in got} == {(f, a, b, n) for f, a, b, n, _ in want}


def test_folding_times_and_edges(spark):
    rows = [("f", 1, 10, 20, "<i>Hello thеre</i>"), ("f", 5, 20, 35, "HELLO ｔｈｅｒｅ!"), ("f", 6, None, None, "hello there"), ("f", 7, 50, 60, "Bye"), ("f", 8, 60, 70, "?"), ("f", 9, 70, 80, "!")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = {(r.first, r.last, r.n, r.duration_ms, r.text) for r in collapse_runs(df, "file", "ord", "text", F.col("s"), F.col("e")).collect()}
    assert out == {(1, 6, 3, 25, "<i>Hello thеre</i>"), (7, 7, 1, 10, "Bye"), (8, 9, 2, 20, "?")}
    assert collapse_runs(df.limit(0), "file", "ord", "text", F.col("s"), F.col("e")).count() == 0


def test_long_texts(spark):
    df = spark.createDataFrame([("f", 1, 0, 1, "x" * 200_000, 1, "x"), ("f", 2, 1, 2, "x" * 200_000, 1, "x"), ("f", 3, 2, 3, "y", 1, "x")], SCHEMA)
    assert {(r.first, r.last) for r in collapse_runs(df, "file", "ord", "text", F.col("s"), F.col("e")).collect()} == {(1, 2), (3, 3)}


def test_a_line_that_returns_is_a_run_of_its_own(spark):
    """Both runs of A have one canonical value; only the difference of row numbers parts them."""
    a, near_a, b = "the lantern was lost", "the lantern was lust", "nobody came home again"
    df = spark.createDataFrame([("f", k, k, k + 1, t, 1, "x") for k, t in enumerate([a, near_a, b, a, a, b, None, b])], SCHEMA)
    got = {(r.first, r.last, r.n) for r in collapse_runs(df, "file", "ord", "text", F.col("s"), F.col("e")).collect()}
    assert got == {(0, 1, 2), (2, 2, 1), (3, 4, 2), (5, 5, 1), (7, 7, 1)}


def test_chain_that_drifts_back_to_its_first_text(spark):
    """Each is near the one before, yet the last is far from the first, which then comes again."""
    steps = ["a" * 20, "a" * 18 + "bb", "a" * 16 + "bbbb", "a" * 14 + "b" * 6]
    texts = steps * 3
    for block in (3, 5, 4096):
        df = spark.createDataFrame([("f", k, k, k + 1, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)
        got = {(r.first, r.last, r.n) for r in collapse_runs(df, "file", "ord", "text", F.col("s"), F.col("e"), block).collect()}
        assert got == {(0, 3, 4), (4, 7, 4), (8, 11, 4)}
