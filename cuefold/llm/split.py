"""Oversized texts cut into overlapping pieces at natural boundaries.

For each text the smallest possible number of pieces is computed, equal-length
targets are placed, and each cut snaps to the strongest boundary near its target;
if a piece would pass the limit, one more piece is taken.  A text is one row, so
rows are independent and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.codes import SPACE, classes, codes, token_spans

# Boundary strengths before a token, from any place between tokens to a gap between cues.
INSIDE, WORD_GAP, SENTENCE, LINE, PARAGRAPH, CUE = range(6)
NAMES = ["inside", "word", "sentence", "line", "paragraph", "cue"]
_SENTENCE_ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


def strengths(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
    """Strength of the boundary before each token."""
    n = len(starts)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    prev_end = np.concatenate(([0], ends[:-1]))
    space = np.concatenate(([0], np.cumsum(classes()[c] == SPACE)))
    gap = space[starts] - space[prev_end] > 0
    out[gap] = WORD_GAP
    last = np.concatenate(([0], c[np.maximum(ends[:-1] - 1, 0)]))
    out[gap & np.isin(last, _SENTENCE_ENDS)] = SENTENCE
    feeds = np.concatenate(([0], np.cumsum(c == 10)))
    lines = feeds[starts] - feeds[prev_end]
    out[lines >= 1] = LINE
    out[lines >= 2] = PARAGRAPH
    if "-->" in text:
        # A cue begins with its timing line or with the line of its number before it.
        line_of = feeds[starts]
        body, at, timing = text.split("\n"), 0, set()
        for k, line in enumerate(body):
            if "-->" in line:
                timing.add(k - 1 if k and body[k - 1].strip().isdigit() else k)
        cue_lines = np.fromiter(timing, np.int64, len(timing))
        out[(lines >= 1) & np.isin(line_of, cue_lines)] = CUE
    out[0] = CUE
    return out


def _place(strength: np.ndarray, limit: int, overlap: int, count: int) -> list[int] | None:
    """Cuts into ``count`` pieces, None if some piece would pass the limit."""
    n, fresh = len(strength), limit - overlap
    # The first piece has room for the overlap besides its share.
    share = (n - overlap) / count
    at, reach = [0], max(16, int(share / 4))
    for k in range(1, count):
        target = overlap + share * k
        # What follows must still fit into the pieces left.
        least = max(at[-1] + 1, n - fresh * (count - k))
        most = min(at[-1] + (limit if k == 1 else fresh), n - 1)
        if least > most:
            return None
        lo, hi = max(least, int(target) - reach), min(most, int(target) + reach)
        if lo > hi:
            lo, hi = least, most
        near = strength[lo : hi + 1].astype(np.int64)
        # Strongest first, then nearest to the target.
        far = np.abs(np.arange(lo, hi + 1) - target)
        at.append(lo + int(np.lexsort((far, -near))[0]))
    return at if n - at[-1] <= (fresh if count > 1 else limit) else None


def cuts(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """First own token of each piece.  Piece k also repeats the ``overlap`` tokens before it.

    The minimum number of pieces may leave cuts no room to move to a boundary; one piece
    more is taken where that turns the weakest cut below a line into a stronger one.
    """
    n = len(strength)
    if n <= limit:
        return [0]
    count = 1 + -(-(n - limit) // (limit - overlap))
    while (at := _place(strength, limit, overlap, count)) is None:
        count += 1
    weakest = lambda x: int(strength[x[1:]].min())
    if weakest(at) < LINE and (more := _place(strength, limit, overlap, count + 1)) and weakest(more) > weakest(at):
        return more
    return at


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ident, text in zip(pdf["ident"], pdf["text"], strict=True):
                c = codes(text)
                starts, ends = token_spans(c)
                n = len(starts)
                if n <= limit:
                    continue
                s = strengths(c, starts, ends, text)
                at = cuts(s, limit, overlap)
                stop = at[1:] + [n]
                for k, (own, end) in enumerate(zip(at, stop, strict=True)):
                    first = max(0, own - overlap) if k else 0
                    a = int(starts[first]) if k else 0
                    b = int(starts[end]) if end < n else len(text)
                    rows.append((ident, k, len(at), n, text[a:b], end - first, own - first, own, NAMES[int(s[own])]))
                if len(rows) > 2000:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)

    return run


COLUMNS = ["ident", "piece", "pieces", "doc_tokens", "text", "tokens", "repeated", "first_token", "boundary"]


def split_oversized(df: DataFrame, ident: str, text: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """Ordered pieces of at most ``limit`` tokens of every text that has more.

    Result: ``ident`` column, ``piece`` (from 0), ``pieces``, ``doc_tokens``, ``text``,
    ``tokens`` (repeated ones included), ``repeated`` (tokens of the piece before,
    ``overlap`` of them except in the first piece), ``first_token``, ``boundary`` (what the
    piece begins at).  Pieces without their repeated tokens give the text again.
    Texts within the limit and null texts give no row; an unbroken text is cut between
    tokens; a row repeated in the input is cut as often as it comes.  Only
    ``ident`` and ``text`` are read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = df.schema[ident].dataType.simpleString()
    # A text of at most ``limit`` characters has no more tokens than that.
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where(F.length("text") > limit)
    schema = (
        f"ident {kind}, piece int, pieces int, doc_tokens long, text string, tokens long, repeated long, "
        "first_token long, boundary string"
    )
    return rows.mapInPandas(_pieces(limit, overlap), schema).withColumnRenamed("ident", ident)
