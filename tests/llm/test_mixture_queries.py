import numpy as np

from cuefold.llm import queries
from cuefold.llm.mixture import flight, landing, mix_sources
from cuefold.llm.queries import QUERIES


def _tables(spark, tmp_path, docs, targets):
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(targets, "source string, weight double, max_uses int").write.parquet(f"{tmp_path}/mix_target.parquet")
    return str(tmp_path)


def test_limits_of_sources_without_tokens(spark, tmp_path):
    """Sources without documents or without a token have no rate, and null texts no token count."""
    docs = [(k, "big", "a b c d" if k % 5 else None) for k in range(40)] + [(50, "blank", " "), (51, "blank", None), (52, None, "a"), (53, "other", "a b")]
    sf = _tables(spark, tmp_path, docs, [("big", 0.5, 1), ("blank", 0.3, 2), ("none", 0.2, 3)])
    rows = {r.doc_id: (r.source, r.tokens, r.within_uses) for r in QUERIES["p7_limits"](spark, sf).collect()}
    want = {k: ("big", 4 if k % 5 else None, True) for k in range(40)} | {50: ("blank", 0, True), 51: ("blank", None, True)}
    assert rows == want


def test_draws_keep_expected_uses():
    """Over the draws, each document is used as often as its probability says, and the tokens miss by less than the longest document."""
    p, t = np.array([0.3, 0.3, 0.3, 0.3, 0.3, 0.7, 0.7]), np.array([1.0, 2.0, 40.0, 3.0, 900.0, 0.0, 7.0])
    draws = [landing(flight(p, t, seed), t, seed) for seed in range(4000)]
    assert set(np.unique(draws)) == {0.0, 1.0} and np.abs(np.mean(draws, axis=0) - p).max() < 0.04
    assert all(abs(((d - p) * t).sum()) < t.max() and abs((d - p).sum()) < 2 for d in draws)
    assert (landing(flight(p, t, 5), t, 5) == draws[5]).all()


def test_found_comes_from_the_drawn_uses(spark, tmp_path, monkeypatch):
    """Sources fall short by the uses drawn: of the one mixture of the query, all or not all of what they can give."""
    docs = [(k, "big" if k % 4 else "small", "a b c" if k % 3 else "a b c d e f") for k in range(200)] + [(300, "blank", " "), (301, None, "a")]
    sf = _tables(spark, tmp_path, docs, [("big", 0.4, 1), ("small", 0.4, 1), ("blank", 0.1, 2), ("none", 0.1, 3), ("zero", 0.0, 1)])
    drawn = []

    def spy(*args):
        drawn.append(mix_sources(*args))
        return drawn[-1]

    monkeypatch.setattr(queries, "mix_sources", spy)
    assert {r.source for r in QUERIES["p7_found"](spark, sf).collect()} == {"small", "blank", "none"}
    [(uses, _)] = drawn
    used = {s: {r.uses for r in uses.collect() if r.source == s} for s in ("big", "small")}
    assert used == {"big": {0, 1}, "small": {1}}


def test_found_of_targets_that_differ(spark, tmp_path):
    """Two targets of one source fall short each by itself."""
    docs = [(k, "a" if k % 5 == 0 else "b", "x y") for k in range(100)]
    sf = _tables(spark, tmp_path, docs, [("a", 0.3, 1), ("a", 0.5, 2), ("a", 0.1, 1), ("b", 0.1, 1)])
    assert sorted(r.source for r in QUERIES["p7_found"](spark, sf).collect()) == ["a", "a"]
