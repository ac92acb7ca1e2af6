import numpy as np
from pyspark.sql import functions as F

from cuefold.llm.mixture import flight, landing, mix_sources

TARGET = "source string, weight double, max_uses int"


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 3000):
        p, t = rng.random(n), rng.integers(0, 900, n).astype(float)
        x = flight(p, t)
        assert ((x > 0) & (x < 1)).sum() <= 2 and (x >= 0).all() and (x <= 1).all()
        assert abs(x.sum() - p.sum()) < 1e-6 * (n + 1) and abs((x * t).sum() - (p * t).sum()) < 1e-5 * (n + 1) * 900
        done = landing(x, t)
        assert set(np.unique(done)) <= {0.0, 1.0} and abs((done * t).sum() - (p * t).sum()) <= 900


def test_equal_tokens():
    x = flight(np.full(10, 0.3), np.full(10, 5.0))
    assert abs(x.sum() - 3) < 1e-9


def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [(k, ["big", "big", "big", "small", None, "other"][k % 6], int(rng.integers(1, 200)), "clash") for k in range(3000)]
    docs = spark.createDataFrame(rows, "id bigint, src string, n int, uses string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.25, 3), ("none", 0.05, 5), ("tiny", 0.0, 2)], TARGET)
    budget = sum(r[2] for r in rows if r[1])
    for group in (16, 4096):
        uses, report = mix_sources(docs, targets.withColumnRenamed("source", "src"), "id", "src", F.col("n").cast("long"), group)
        u = uses.collect()
        assert {r.source for r in u} == {"big", "small"} and len(u) == sum(r[1] in ("big", "small") for r in rows) == len({r.ident for r in u})
        rep = {r.source: r for r in report.collect()}
        assert all(r.uses in (0, 1) for r in u if r.source == "big") and all(r.uses <= 3 for r in u)
        for s, w in (("big", 0.3), ("small", 0.25)):
            used = sum(r.uses * r.tokens for r in u if r.source == s)
            assert used == rep[s].used_tokens and abs(used - w * budget) <= 200
            assert rep[s].budget == budget and not rep[s].falls_short
        # Counts of documents are balanced too.
        n_big = rep["big"].docs
        assert abs(rep["big"].used_docs - n_big * 0.3 * budget / rep["big"].tokens) <= 2
        assert rep["none"].falls_short and rep["none"].tokens == 0 and not rep["tiny"].falls_short and rep["tiny"].used_docs == 0


def test_capped_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 90), (2, "b", 90)], "id bigint, source string, n bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGET)
    uses, report = mix_sources(docs, targets, "id", "source", F.col("n"))
    assert {(r.ident, r.uses) for r in uses.collect() if r.source == "a"} == {(1, 2)}
    assert {r.source: r.falls_short for r in report.collect()} == {"a": True, "b": False}
    uses, report = mix_sources(docs.limit(0), targets, "id", "source", F.col("n"))
    assert uses.count() == 0 and [(r.share, r.used_tokens) for r in report.collect()] == [(None, 0), (None, 0)]
    uses, report = mix_sources(docs, targets.limit(0), "id", "source", F.col("n"))
    assert uses.count() == 0 and report.count() == 0
