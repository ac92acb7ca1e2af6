import random

from pyspark.sql import functions as F

from cuefold.operators import blocked
from cuefold.operators.intervals import merge_intervals, periods_and_gaps

SCHEMA = "file string, ord int, s bigint, e bigint, start_ms bigint, entity string"


def brute(rows):
    out = []
    for f in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, e, o) for g, o, s, e in {r[:4] for r in rows} if g == f and s is not None and e is not None and e > s)
        cur = None
        periods = []
        for s, e, o in spans:
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                cur[2].add(o)
            else:
                cur = [s, e, {o}]
                periods.append(cur)
        for k, (s, e, os) in enumerate(periods):
            out.append((f, s, e, min(os), max(os), periods[k + 1][0] if k + 1 < len(periods) else None))
    return sorted(out, key=str)


def run(spark, rows, block):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    return merge_intervals(df, "file", F.col("s"), F.col("e"), F.col("ord"), block_ms=block)


def test_merge_equals_brute_force(spark):
    rng = random.Random(2)
    for block in (50, 1000, 10**7):
        rows = []
        for k in range(300):
            s = rng.randrange(0, 4000)
            rows.append((rng.choice(["a", "b", "hot", "hot", None]), k, rng.choice([s] * 9 + [None]), rng.choice([s + rng.randrange(-2, 60), s + 400, None, s + 10, s + 10])))
        rows += rows[:20]
        got = [(r.file, r.start_ms, r.end_ms, r.first_member, r.last_member, r.next_start_ms) for r in run(spark, rows, block).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_touching_and_gaps(spark):
    rows = [("f", 1, 0, 1000), ("f", 2, 1000, 2000), ("f", 3, 10_000, 11_000), ("f", 4, 700_000, 700_001), ("f", 1, 0, 1000)]
    got = {(r.kind, r.start_ms, r.end_ms) for r in periods_and_gaps(run(spark, rows, 3_600_000), "file", 8_000, 600_000).collect()}
    assert got == {("period", 0, 2000), ("gap", 2000, 10_000)}
    assert run(spark, [], 1000).count() == 0


def test_carry_and_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, k])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for forward in (True, False):
        got = {r.o: r.x for r in blocked.carry(df, ["g"], F.floor(F.col("o") / 16), ["o"], F.col("v"), "x", forward).collect()}
        for g, o, _ in rows:
            near = [v for h, p, v in rows if h == g and v is not None and (p < o if forward else p > o)]
            assert got[o] == ((near[-1] if forward else near[0]) if near else None)
    got = {r.o: r.n for r in blocked.numbered(df.where("g is not null"), ["g"], F.floor(F.col("o") / 16), ["o"], "n").collect()}
    for o, n in got.items():
        assert n == sum(1 for h, p, _ in rows if h == rows[o][0] and p <= o)
