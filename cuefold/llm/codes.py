"""Vectorised text work on code points, shared by the Arrow-batched operators."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from cuefold.llm.lookalike import tables

SPACE, WORD, OTHER = 0, 1, 2
#: Code points beyond this are rare letters and signs; they share one class each way.
_TOP = 0x20000


def codes(text: str) -> np.ndarray:
    """The code points of ``text``."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point: white space, letter or digit (or underscore), or something else."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(_TOP):
        c = chr(cp)
        if c.isspace() or unicodedata.category(c)[0] == "Z":
            table[cp] = SPACE
        elif unicodedata.category(c)[0] in "LN" or c == "_":
            table[cp] = WORD
    table[_TOP:0x32000] = WORD
    return table


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Of each code point: 0 to drop it, else its look-alike in lower case; accents stay."""
    single, _ = tables()
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for cp in range(_TOP):
        c = single.get(chr(cp), chr(cp))
        low = c.lower()
        table[cp] = ord(low) if len(low) == 1 else ord(c) if c else 0
    return table


def fold(text: str) -> np.ndarray:
    """Code points of ``text``, look-alikes and letter case made one, invisible ones dropped."""
    if not text.isascii():
        several = tables()[1]
        for c in several.keys() & set(text):
            text = text.replace(c, several[c])
    c = fold_table()[codes(text)]
    if not text.isascii():
        c = c[c != 0]
        if ((c >= 0x300) & (c < 0x370)).any():
            whole = unicodedata.normalize("NFC", c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
            c = codes(whole)
    return c


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def token_spans(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens: stretches of one class other than white space."""
    cls = classes()[c]
    change = np.flatnonzero(np.diff(cls)) + 1
    bounds = np.concatenate(([0], change, [len(cls)])) if len(cls) else np.zeros(1, np.int64)
    starts, ends = bounds[:-1], bounds[1:]
    keep = cls[starts] != SPACE if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]
