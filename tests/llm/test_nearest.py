import random

from pyspark.sql import functions as F

from cuefold.llm.nearest import nearest_in_time

SCHEMA = "file string, id bigint, t bigint, cell int, entity string, text string"


def run(spark, left, right, tol):
    l, r = (spark.createDataFrame([(*x, 1, "e", None) for x in rows], SCHEMA) for rows in (left, right))
    got = nearest_in_time(l, r, "file", F.col("t"), F.col("t"), F.col("id"), F.col("id"), tol).collect()
    assert len(got) == len({x.left_id for x in got})
    return {(x.left_id, x.right_id, x.diff_ms) for x in got}


def brute(left, right, tol):
    out = set()
    for f, i, t in set(left):
        near = [(abs(u - t), j, u - t) for g, j, u in set(right) if f is not None and g == f and t is not None and u is not None and abs(u - t) <= tol]
        if near:
            _, j, d = min(near)
            out.add((i, j, d))
    return out


def rows(rng, n, base, span):
    out = [(rng.choice(["hot", "hot", "hot", "a", None]), base + k, rng.choice([rng.randrange(-span, span)] * 9 + [None])) for k in range(n)]
    return out + out[: n // 10]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    for tol, span in ((250, 5_000), (250, 300_000), (1, 40), (0, 20), (40, 400)):
        left, right = rows(rng, 200, 0, span), rows(rng, 200, 1000, span)
        assert run(spark, left, right, tol) == brute(left, right, tol)


def test_ties_go_to_the_smaller_id(spark):
    assert run(spark, [("f", 1, 100)], [("f", 12, 90), ("f", 11, 110)], 250) == {(1, 11, 10)}
    assert run(spark, [("f", 1, 100)], [("f", 11, 90), ("f", 12, 110)], 250) == {(1, 11, -10)}
    assert run(spark, [("f", 1, 100)], [("f", 12, 90), ("f", 11, 90)], 250) == {(1, 11, -10)}


def test_tolerance_is_inclusive_and_blocks_meet(spark):
    edge = 250 * 256
    left = [("f", 1, edge), ("f", 2, edge - 1), ("f", 3, 0)]
    right = [("f", 11, edge + 250), ("f", 12, edge - 251), ("f", 13, -251)]
    assert run(spark, left, right, 250) == {(1, 11, 250), (2, 12, -250)}


def test_empty(spark):
    assert run(spark, [], [("f", 1, 1)], 5) == set()
    assert run(spark, [("f", 1, 1)], [], 5) == set()
