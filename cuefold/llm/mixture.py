"""Mixing sources to target weights by balanced sampling (the cube method).

Each document of a source has the same expected number of uses; its whole part
is used outright and the fraction is an inclusion probability.  The flight phase
moves probabilities along directions in the null space of the balancing
constraints (tokens and documents of the source), so both totals stay fixed while
one document after the other reaches 0 or 1.  Which way along a direction is drawn,
with chances that leave every expected number of uses as it was.  Documents fly in
groups of bounded size; what is left undecided, at most two per group, flies again
until at most two per source remain.  The landing decides those by giving up one
constraint after the other, the number of documents before the tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.session import cut, spread

#: Documents that fly together.
GROUP = 4096
#: Tables of one row per source are broadcast up to this many rows.
MOST_SOURCES = 10_000
_EPS = 1e-9


def _move(x: list[float], window: list[int], u: tuple[float, ...], draw: float) -> list[int]:
    """Move ``x`` along ``u``, one way or the other, as far as 0 and 1 allow; what of ``window`` is still open.

    The way is taken with a chance in proportion to how far the other one leads, so ``x`` is kept in expectation.
    """
    moved = [(k, d) for k, d in zip(window, u, strict=True) if d]
    ahead = min((1 - x[k]) / d if d > 0 else -x[k] / d for k, d in moved)
    back = min(x[k] / d if d > 0 else (x[k] - 1) / d for k, d in moved)
    step = ahead if draw * (ahead + back) < back else -back
    for k, d in moved:
        v = x[k] + step * d
        x[k] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
    return [k for k in window if 0 < x[k] < 1]


def flight(p: np.ndarray, tokens: np.ndarray, seed: int = 0) -> np.ndarray:
    """Inclusion probabilities after the flight: all but at most two are 0 or 1.

    Sums of p and of p * tokens stay the same, and so does each p in expectation over the seeds.
    """
    x, t = [float(v) for v in p], [float(v) for v in tokens]
    draws = iter(np.random.default_rng([seed, 0]).random(len(x)).tolist())
    window: list[int] = []
    for new in [k for k, v in enumerate(x) if 0 < v < 1]:
        window.append(new)
        while len(window) == 3:
            a, b, c = window
            # The direction orthogonal to (1, 1, 1) and to the tokens.
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            window = _move(x, window, u if any(u) else (1.0, -1.0, 0.0), next(draws))
    return np.array(x)


def landing(p: np.ndarray, tokens: np.ndarray, seed: int = 0) -> np.ndarray:
    """Decide what the flight left: first the tokens alone stay the same, the last document is drawn.

    The tokens miss the expected ones by less than those of the longest document; each p is
    kept in expectation over the seeds.
    """
    x, t = [float(v) for v in p], [float(v) for v in tokens]
    draws = iter(np.random.default_rng([seed, 1]).random(len(x)).tolist())
    window: list[int] = []
    for new in [k for k, v in enumerate(x) if 0 < v < 1]:
        window.append(new)
        while len(window) == 2:
            u = (t[window[1]], -t[window[0]])
            window = _move(x, window, u if any(u) else (1.0, -1.0), next(draws))
    if window:
        _move(x, window, (1.0,), next(draws))
    return np.array(x)


def _fly(last: bool, turn: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Draws depend on the group and its documents alone, so a task that runs again draws the same.
        drawn = zlib.crc32(repr((seed, turn, int(key[0]), int(key[1]))).encode())
        pdf = pdf.sort_values(["tokens", "ident", "p"], kind="stable").reset_index(drop=True)
        t = pdf["tokens"].fillna(0).to_numpy(float)
        p = flight(pdf["p"].to_numpy(float), t, drawn)
        pdf["p"] = landing(p, t, drawn) if last else p
        return pdf[["ident", "source", "target", "tokens", "whole", "p"]]

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is of a size that allows it."""
    return F.broadcast(df) if df.count() <= MOST_SOURCES else df


def mix_plan(docs: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """One row per target source: its tokens, documents, budget and expected uses of a document.

    ``docs`` has ``ident, source, tokens``; ``targets`` has ``source, weight, max_uses``.  The
    budget is the tokens of all documents with a source.  A source whose tokens, used
    ``max_uses`` times, stay below its share ``falls_short``; one without documents has 0 tokens.
    """
    per_source = cut(docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    budget = per_source.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.select(F.col(source).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_uses").cast("long").alias("max_uses")).distinct()
    share = F.col("weight") * F.lit(float(budget))
    return (
        wanted.join(per_source, "source", "left")
        .select(
            "source", "weight", "max_uses", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"),
            F.lit(budget).cast("long").alias("budget"),
        )
        .withColumn("falls_short", F.col("max_uses") * F.col("tokens") < share)
        .withColumn("uses", F.when(F.col("tokens") > 0, F.least(F.col("max_uses").cast("double"), share / F.col("tokens"))).otherwise(F.lit(0.0)))
    )


def mix_sources(
    df: DataFrame, targets: DataFrame, ident: str, source: str, tokens: Column, group: int = GROUP, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(uses, report) of the mixture.

    ``uses``: ``ident, source, tokens, uses`` of each document of a target source, 0 included.
    ``report``: per target source ``weight, max_uses, docs, tokens, budget, falls_short, used_docs,
    used_tokens, share`` (of all used tokens).

    Documents without a source or of a source not aimed at are used nowhere, and the former
    do not count for the budget.  Null tokens count as 0 and stay null in ``uses``.  A repeated
    ident stands for as many documents.  With no documents used every share is null; targets
    without documents stay in the report.  ``targets`` is one row per source; null weights aim
    at nothing.  Targets of one source that differ are drawn each by itself.  The same ``seed``
    draws the same uses.
    """
    texts = spread(df)
    docs = cut(texts.select(F.col(ident).alias("ident"), F.col(source).alias("source"), tokens.alias("tokens")))
    plan = cut(mix_plan(docs, targets, source).withColumn("target", F.xxhash64("source", "weight", "max_uses")))
    kind = docs.schema["ident"].dataType.simpleString()
    rates = _small(plan.where("docs > 0 and uses is not null").select("source", "target", "uses"))
    part = (
        docs.join(rates, "source")
        .withColumn("whole", F.floor(F.col("uses") + _EPS))
        .withColumn("p", F.greatest(F.col("uses") - F.col("whole"), F.lit(0.0)))
    )
    settled = part.where(f"p <= {_EPS}").select("ident", "source", "target", "tokens", F.col("whole").alias("uses"))
    rest = part.where(f"p > {_EPS}").select("ident", "source", "target", "tokens", "whole", "p")
    schema = f"ident {kind}, source string, target long, tokens long, whole long, p double"
    decided = []
    while True:
        # Each round leaves at most two documents of a group, so rounds are few.
        sizes = cut(rest.groupBy("target").agg(F.count("*").alias("n_open")))
        most = sizes.agg(F.max("n_open")).first()[0]
        if not most:
            break
        last = most <= group
        bucket = F.lit(0) if last else F.pmod(F.xxhash64("ident", F.lit(len(decided))), F.ceil(F.col("n_open") / group))
        flown = cut(rest.join(_small(sizes), "target").groupBy("target", bucket.alias("bucket")).applyInPandas(_fly(last, len(decided), seed), schema))
        decided.append(flown.where("p <= 0 or p >= 1"))
        if last:
            break
        rest = flown.where("p > 0 and p < 1")
    uses = settled
    for d in decided:
        uses = uses.unionByName(d.select("ident", "source", "target", "tokens", (F.col("whole") + F.round("p").cast("long")).alias("uses")))
    used = cut(uses.groupBy("target").agg(F.sum("uses").alias("used_docs"), F.sum(F.col("uses") * F.col("tokens")).alias("used_tokens")))
    total = used.agg(F.sum("used_tokens")).first()[0]
    report = plan.drop("uses").join(used, "target", "left").drop("target").withColumns({
        "used_docs": F.coalesce("used_docs", F.lit(0)),
        "used_tokens": F.coalesce("used_tokens", F.lit(0)),
        "share": F.coalesce("used_tokens", F.lit(0)) / F.lit(float(total) if total else None).cast("double"),
    })
    return uses.drop("target"), report
