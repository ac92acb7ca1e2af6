import random

from cuefold.operators import pairing
from cuefold.operators.pairing import nearest_unmatched

SCHEMA = "file string, id bigint, ord bigint, start double"


def run(spark, frames, targets, *tolerance):
    f = spark.createDataFrame(frames, SCHEMA + ", usable boolean")
    return {tuple(r) for r in nearest_unmatched(f, spark.createDataFrame(targets, SCHEMA), *tolerance).collect()}


def brute(frames, targets, tol=0.08):
    out, used = set(), set()
    for file, fid, _, pts, usable in sorted((f for f in frames if f[0] is not None and f[3] is not None), key=lambda f: (f[2], f[1])):
        near = [(abs(t[3] - pts), t[2], t[1]) for t in targets if t[0] == file and t[3] is not None and t[1] not in used and abs(t[3] - pts) <= tol]
        if usable and near:
            used.add(min(near)[2])
            out.add((fid, min(near)[2]))
    return out


def test_stream_order_decides(spark):
    """The frame that comes first in the stream takes the target, though a later one is earlier in time."""
    assert run(spark, [("f", 1, 0, 2.0, True), ("f", 2, 1, 1.95, True)], [("f", 9, 0, 1.99)]) == {(1, 9)}
    assert run(spark, [("f", 1, 0, 2.0, False), ("f", 2, 1, 1.95, True), ("f", 3, 2, 1.99, None)], [("f", 9, 0, 1.99)]) == {(2, 9)}


def test_tie_goes_to_the_lowest_target(spark):
    assert run(spark, [("f", 1, 0, 1.0, True)], [("f", 5, 0, 1.0625), ("f", 4, 1, 0.9375)]) == {(1, 5)}


def test_tolerance(spark):
    frames, targets = [("f", 1, 0, 1.0, True)], [("f", 5, 0, 1.07), ("g", 6, 0, 1.0), (None, 7, 0, 1.0), ("f", 8, 1, None)]
    assert run(spark, frames, targets, float("nan")) == {(1, 5)} and run(spark, frames, targets, 0.05) == set()
    assert run(spark, [], targets) == set() == run(spark, frames, [])


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    frames = [(f, k + 1000 * n, rng.randrange(60), round(rng.uniform(0, 6), 3), rng.random() < 0.8) for n, f in enumerate("ab") for k in range(120)]
    targets = [(f, 5000 + k + 1000 * n, k, round(rng.uniform(0, 6), 3)) for n, f in enumerate("ab") for k in range(120)]
    want = brute(frames, targets)
    assert run(spark, frames, targets) == want
    monkeypatch.setattr(pairing, "FOLD_ROWS", 3)
    assert run(spark, frames, targets) == want
