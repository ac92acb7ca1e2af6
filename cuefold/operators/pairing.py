"""One-to-one pairing of cues by nearest start under a tolerance.

References take candidates greedily in order of start, so pairing carries state.
It cannot cross a gap in the merged starts that is wider than the tolerance, so a
file is split into islands at such gaps, and the fold runs within an island.  The
islands of a file are found in blocks of time, as a file may hold a third of all
rows: a block's first island goes on with the one before where no gap parts them.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuefold.session import cut

TOLERANCE = 0.04
#: Width of the time blocks in which gaps are sought, in seconds.
BLOCK_S = 3600.0
#: Rows of an island that one fold may hold as arrays; a larger island is walked in order.
FOLD_ROWS = 400


def _islands(ref: DataFrame, cand: DataFrame, tol: float) -> DataFrame:
    """Rows of both sides with ``isl``, the start of the island each is in."""
    both = ref.select("file", "id", "ord", "start", F.lit(0).alias("side")).unionByName(
        cand.select("file", "id", "ord", "start", F.lit(1).alias("side"))
    ).where("file is not null and start is not null and not isnan(start)").withColumn("block", F.floor(F.col("start") / BLOCK_S))
    w = Window.partitionBy("file", "block").orderBy("start", "side", "ord", "id")
    files = Window.partitionBy("file").orderBy("block")
    # A guard above the tolerance: rounding must never part what may pair.
    wide = tol + 1e-6
    inner = both.withColumn("brk", F.when(F.col("start") - F.lag("start").over(w) > wide, F.col("start")))
    ends = (
        inner.groupBy("file", "block").agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.max("brk").alias("last_brk"))
        .withColumn("before", F.lag("hi").over(files))
        .withColumn("own", F.when(F.col("before").isNull() | (F.col("lo") - F.col("before") > wide), F.col("lo")))
        .withColumn("opens", F.coalesce("last_brk", "own"))
        .withColumn("carry", F.last("opens", ignorenulls=True).over(files.rowsBetween(Window.unboundedPreceding, -1)))
        .select("file", "block", F.coalesce("own", "carry").alias("first_isl"))
    )
    return (
        inner.withColumn("cur", F.last("brk", ignorenulls=True).over(w)).join(ends, ["file", "block"])
        .select("file", "id", "ord", "start", "side", F.coalesce("cur", "first_isl").alias("isl"))
    )


def _fold(tol: float, in_stream: bool = False):
    """The pairs of an island from its arrays ``rs`` and ``cs``, ``rs`` in the order in which they choose."""
    near = f"abs(k.start - r.start) <= {tol}D" if in_stream else f"k.start >= r.start - {tol}D and k.start - r.start <= {tol}D"
    tie = "'o', k.ord" if in_stream else "'s', k.start, 'o', k.ord"
    step = f"""
      aggregate(rs, named_struct('used', cast(array() as array<bigint>), 'pairs', cast(array() as array<struct<r:bigint,c:bigint>>)),
        (acc, r) -> aggregate(
          slice(array_sort(transform(
            filter(cs, k -> {near} and not array_contains(acc.used, k.id)),
            k -> named_struct('d', abs(k.start - r.start), {tie}, 'id', k.id))), 1, 1),
          acc, (a, k) -> named_struct('used', array_append(a.used, k.id), 'pairs', array_append(a.pairs, named_struct('r', r.id, 'c', k.id))))
      ).pairs"""
    return F.expr(step)


def _walk(tol: float):
    """The same greedy choice over a long island, arriving in order of start in many batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, refs, cands, out = None, deque(), deque(), []

        def settle(upto: float) -> None:
            # References whose whole window has arrived choose now.
            while refs and refs[0][0] + tol + 1e-6 < upto:
                start, rid = refs.popleft()
                while cands and cands[0][0] < start - tol - 1e-6:
                    cands.popleft()
                near = [(abs(c - start), c, o, i, k) for k, (c, o, i) in enumerate(cands) if c >= start - tol and c - start <= tol]
                if near:
                    best = min(near)
                    del cands[best[4]]
                    out.append((rid, best[3]))

        for pdf in batches:
            for file, isl, side, start, order, ident in zip(*(pdf[c].tolist() for c in ("file", "isl", "side", "start", "ord", "id")), strict=True):
                if (file, isl) != key:
                    settle(float("inf"))
                    key = (file, isl)
                    refs.clear()
                    cands.clear()
                settle(start)
                if side == 0:
                    refs.append((start, ident))
                else:
                    cands.append((start, order, ident))
            if out:
                yield pd.DataFrame(out, columns=["ref_id", "cand_id"])
                out = []
        settle(float("inf"))
        if out:
            yield pd.DataFrame(out, columns=["ref_id", "cand_id"])

    return run


def pair_cues(ref: DataFrame, cand: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(ref_id, cand_id) of the greedy one-to-one pairing.

    Both inputs have ``file, id, ord, start`` with ids unique over each table and ``ord`` the
    order in the file, which decides ties.  For each reference in order of start the unused
    candidate with start >= ref - tol and start - ref <= tol (in doubles, as written)
    that is nearest wins, on a tie the earlier one.  Rows without file or start pair with
    nothing; repeated rows must be removed before.  Empty inputs give no rows.  A very long
    island, in which no gap is wider than the tolerance, is walked as a sorted stream, for
    the rule is sequential there; memory holds only what lies within the tolerance.
    """
    # Islands are counted, then folded or walked: three readings of a few narrow columns.
    isl = cut(_islands(ref, cand, tolerance))
    row = F.struct("start", "ord", "id")
    groups = isl.groupBy("file", "isl").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("nr"))
    # Only islands with both sides can give pairs; arrays are gathered for short ones only.
    sized = isl.join(groups.where("nr > 0 and nr < n"), ["file", "isl"])
    short = (
        sized.where(f"n <= {FOLD_ROWS}").groupBy("file", "isl")
        .agg(F.array_sort(F.collect_list(F.when(F.col("side") == 0, row))).alias("rs"), F.array_sort(F.collect_list(F.when(F.col("side") == 1, row))).alias("cs"))
        .select(F.explode(_fold(tolerance)).alias("p")).select(F.col("p.r").alias("ref_id"), F.col("p.c").alias("cand_id"))
    )
    long = (
        sized.where(f"n > {FOLD_ROWS}").repartition("file", "isl").sortWithinPartitions("file", "isl", "start", "side", "ord", "id")
        .select("file", "isl", "side", "start", "ord", "id").mapInPandas(_walk(tolerance), "ref_id bigint, cand_id bigint")
    )
    return short.unionByName(long)


def _stream(tol: float):
    """The choice in stream order over a long island: its targets arrive first, then its frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, found = None, []
        starts: list[float] = []
        free: list[tuple] = []
        for pdf in batches:
            for file, isl, side, start, order, ident in zip(*(pdf[c].tolist() for c in ("file", "isl", "side", "start", "ord", "id")), strict=True):
                if (file, isl) != key:
                    key, starts, free = (file, isl), [], []
                if side == 1:
                    starts.append(start)
                    free.append((start, order, ident))
                    continue
                low, high = bisect.bisect_left(starts, start - tol - 1e-6), bisect.bisect_right(starts, start + tol + 1e-6)
                near = [(abs(t - start), o, i, k) for k, (t, o, i) in enumerate(free[low:high], low) if abs(t - start) <= tol]
                if near:
                    best = min(near)
                    # A taken target stands aside; its place keeps the starts sorted.
                    free[best[3]] = (float("inf"), best[1], best[2])
                    found.append((ident, best[2]))
            if found:
                yield pd.DataFrame(found, columns=["frame_id", "target_id"])
                found = []

    return run


def nearest_unmatched(frames: DataFrame, targets: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """(frame_id, target_id): each frame in stream order takes the nearest target not yet taken.

    Both inputs have ``file, id, ord, start``; ``frames`` has ``usable`` too.  The order of the
    stream is ``ord`` of the frames, whatever their times; a tie goes to the target of the
    smaller ``ord``.  A frame without an image (``usable`` false or null) takes nothing.  A
    tolerance that is no finite number counts as 0.08.  Rows without file or start pair with
    nothing, repeated rows must be removed before, and empty inputs give no rows.  Starts with
    no gap wider than the tolerance are one island, walked by one task if it is long.
    """
    tolerance = tolerance if math.isfinite(tolerance) else 0.08
    isl = cut(_islands(frames.where("usable"), targets, tolerance))
    row = F.struct("ord", "id", "start")
    groups = isl.groupBy("file", "isl").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("nr"))
    sized = isl.join(groups.where("nr > 0 and nr < n"), ["file", "isl"])
    short = (
        sized.where(f"n <= {FOLD_ROWS}").groupBy("file", "isl")
        .agg(F.array_sort(F.collect_list(F.when(F.col("side") == 0, row))).alias("rs"), F.collect_list(F.when(F.col("side") == 1, row)).alias("cs"))
        .select(F.explode(_fold(tolerance, True)).alias("p")).select(F.col("p.r").alias("frame_id"), F.col("p.c").alias("target_id"))
    )
    order = [F.col("file"), F.col("isl"), F.col("side").desc(), F.when(F.col("side") == 1, F.col("start")), F.col("ord"), F.col("id")]
    long = (
        sized.where(f"n > {FOLD_ROWS}").repartition("file", "isl").sortWithinPartitions(*order)
        .select("file", "isl", "side", "start", "ord", "id").mapInPandas(_stream(tolerance), "frame_id bigint, target_id bigint")
    )
    return short.unionByName(long)
