"""Held-out passages that turn up in a corpus, by latent semantic retrieval.

Texts become sequences of folded words.  Passages of the corpus and word runs of the
items are TF-IDF vectors over the items' words (a word no item has adds nothing to
any product with an item), projected by a randomised SVD of the passages.  Item runs
are indexed by cells of near vectors; a passage is compared with the runs of its
nearest cells, and where the cosine is high, document and item are a candidate pair.
Each candidate is checked on its words: the longest run of consecutive words shared
with the item, the longest common subsequence for paraphrases, and the item's answer.

The corpus is read once, whatever the number of items.  What later steps need is
written to the checkpoint folder: counts of words, and the word numbers of documents
with item words.  The SVD is fitted on a sample of those with a passage that holds as
many item words as a verbatim leak needs; every passage is searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.codes import WORD, classes, fold
from cuefold.session import cut, spread

#: Characters that are turned into words at a time.
CHUNK = 1_000_000
#: Documents the SVD is fitted on, at most about this many; every passage is searched.
FIT_DOCUMENTS = 20_000
#: Tasks of the fit: each sends one (words x directions) sum.
FIT_TASKS = 16
#: Words of the latent space; words of a larger vocabulary share places by their hash.
FEATURES = 32_768
#: Latent dimensions, extra random directions and power iterations of the SVD.
RANK, EXTRA, POWER = 96, 16, 2
#: Weight that even the most common word has.
LEAST_IDF = 0.1
#: Cosine from which a passage is a candidate for an item.
COSINE = 0.3
#: Cosine from which the longest common subsequence is taken for paraphrases.
PARAPHRASE_COSINE = 0.6
#: Words from one indexed run of an item to the next.
STRIDE = 4
#: Runs of a cell on average, most cells, and cells a passage is compared with.
CELL_RUNS, MOST_CELLS, PROBES = 64, 2048, 32
#: Runs the cells' centres are fitted on, at most; every run is indexed.
CELL_SAMPLE = 20_000
#: Runs whose vectors a task holds at a time.
RUN_TILE = 262_144
#: Words of documents whose passages are compared at a time.
BATCH_WORDS = 100_000

_MARK = 0xE000  # a private sign that parts texts
_TIMING = re.compile(r"^(?:[ \t]*\d+[ \t]*\r?\n)?[^\n]*-->[^\n]*$", re.M)
_MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_BREAK = re.compile(r"<\s*br\s*/?\s*>", re.I)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _bare(text: str) -> str:
    if "<" in text:
        text = _BREAK.sub("\n", text)
    if "<" in text or "{" in text:
        text = _MARKUP.sub("", text)
    return _TIMING.sub("", text) if "-->" in text else text


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word: a run of letters and digits, look-alikes and case made one."""
    mark = chr(_MARK)
    c = fold(f"\n{mark}\n".join(_bare(t.replace(mark, " ")) for t in texts))
    owner = np.cumsum(c == _MARK)
    word = (classes()[c] == WORD) & (c != 0x5F)
    edge = np.diff(np.concatenate(([0], word.astype(np.int8))))
    first = np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chars = c[word].astype(np.uint64)
    starts = np.cumsum(word)[first] - 1
    length = np.diff(np.append(starts, len(chars)))
    place = np.arange(len(chars)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(length.max()) + 1, _BASE, np.uint64))
        h = np.add.reduceat((chars + np.uint64(1)) * power[place], starts)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, owner[first]


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word numbers."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (ids[k : k + m].astype(np.uint64) + np.uint64(3))) * np.uint64(0x100000001B3) + (h >> np.uint64(31))
    return h


@dataclass
class Items:
    """All items: ids, word numbers in one array with bounds, vocabulary, answers, and the indexed runs of ``n`` words."""

    ids: list
    flat: np.ndarray
    bounds: np.ndarray
    vocabulary: np.ndarray
    answers: list[np.ndarray | None]
    n: int
    starts: np.ndarray
    run_item: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], n: int) -> Items:
        hashes, owner = word_hashes([t for _, t, _ in rows])
        answer, whose = word_hashes([a or "" for _, _, a in rows])
        vocabulary, numbers = np.unique(np.concatenate((hashes, answer)), return_inverse=True)
        flat, bounds = numbers[: len(hashes)].astype(np.int32), np.searchsorted(owner, np.arange(len(rows) + 1))
        answers = [numbers[len(hashes) :][whose == k].astype(np.int32) if a else None for k, (_, _, a) in enumerate(rows)]
        starts, run_item = [], []
        for k, size in enumerate(np.diff(bounds).tolist()):
            if size >= n:
                own = np.unique(np.append(np.arange(0, size - n + 1, STRIDE), size - n))
                starts.append(own + bounds[k])
                run_item.append(np.full(len(own), k))
        empty = np.zeros(0, np.int64)
        return cls([r[0] for r in rows], flat, bounds, vocabulary, answers, n, np.concatenate(starts or [empty]), np.concatenate(run_item or [empty]))

    def words(self, k: int) -> np.ndarray:
        return self.flat[self.bounds[k] : self.bounds[k + 1]]

    def runs(self, which: slice | np.ndarray) -> np.ndarray:
        """Word numbers of indexed runs."""
        return self.flat[self.starts[which][:, None] + np.arange(self.n)]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of all runs of ``n`` words within an item, by hash."""
        hashes = gram_hashes(self.flat, self.n)
        inside = np.searchsorted(self.bounds, np.arange(len(hashes)), "right") == np.searchsorted(self.bounds, np.arange(len(hashes)) + self.n - 1, "right")
        place = np.flatnonzero(inside)
        order = np.argsort(hashes[place], kind="stable")
        return hashes[place][order], place[order]


def _packed(ids: np.ndarray) -> bytes:
    return len(ids).to_bytes(8, "little") + pa.compress(ids.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=4 * size, codec="zstd", asbytes=True), np.int32)


def _scan(vocabulary: np.ndarray, n: int, rewordings: bool):
    """Documents to rows: word counts by number, and documents that may hold a leak."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, steps = np.zeros(len(vocabulary), np.int64), 0
        for pdf in batches:
            idents, texts = pdf["ident"].tolist(), pdf["text"].tolist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                    size += len(texts[b])
                    b += 1
                h, owner = word_hashes(texts[a:b])
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                ids = np.where(vocabulary[at] == h, at, -1).astype(np.int32)
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                # A passage is two steps of n words; documents that hold a word are counted by steps.
                place = np.arange(len(ids)) - bounds[owner] if len(ids) else ids
                longest = int(place.max(initial=0)) // n + 2
                step = owner * longest + place // n
                seen = ids >= 0
                pairs = np.unique(step[seen] * len(vocabulary) + ids[seen])
                counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                steps += int((np.diff(step, prepend=-1) != 0).sum())
                per_step = np.bincount(step[seen], minlength=(b - a) * longest)
                enough = per_step + np.append(per_step[1:], 0) >= n
                docs = np.unique(np.flatnonzero(per_step if rewordings else enough) // longest)
                if len(docs):
                    yield pd.DataFrame({
                        "ident": [idents[a + k] for k in docs], "ids": [_packed(ids[bounds[k] : bounds[k + 1]]) for k in docs],
                        "word": -1, "n": np.isin(docs, np.flatnonzero(enough) // longest).astype(np.int64),
                    })
                a = b
        words = np.append(np.flatnonzero(counts), len(vocabulary))
        yield pd.DataFrame({"ident": None, "ids": None, "word": words, "n": np.append(counts[words[:-1]], steps)})

    return run


def _passages(ids: np.ndarray, n: int, least: int) -> np.ndarray:
    """First word of each passage of 2n words, n apart, with at least ``least`` item words."""
    steps = -(-len(ids) // n)
    per_step = np.bincount(np.flatnonzero(ids >= 0) // n, minlength=steps)
    return np.flatnonzero(per_step + np.append(per_step[1:], 0) >= least) * n


@dataclass
class Space:
    """The latent space: weight of each word, its feature (the last one for no word), and features by dimensions."""

    idf: np.ndarray
    feature: np.ndarray
    basis: np.ndarray

    @classmethod
    def of(cls, idf: np.ndarray) -> Space:
        size = min(len(idf), FEATURES)
        return cls(np.append(idf, 0).astype(np.float32), np.append(np.arange(len(idf)) % size, size).astype(np.int64), np.zeros((size + 1, 0), np.float32))

    def with_basis(self, basis: np.ndarray) -> Space:
        return Space(self.idf, self.feature, np.concatenate((basis, np.zeros((1, basis.shape[1])))).astype(np.float32))

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Projected TF-IDF vectors of rows of word numbers; -1 stands for no word."""
        out = np.zeros((len(rows), self.basis.shape[1]), np.float32)
        # Words that occur get a small table of their own; places without a word are left out.
        there = np.zeros(len(self.idf), bool)
        there[rows] = True
        words = np.flatnonzero(there)
        number = np.zeros(len(self.idf), np.int32)
        number[words] = np.arange(len(words))
        table = self.basis[self.feature[words]] * self.idf[words, None]
        for k in range(rows.shape[1]):
            at = np.flatnonzero(rows[:, k] >= 0)
            out[at] += table[number[rows[at, k]]]
        return out

    def spread_back(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, sums): A'A times the basis for the rows A."""
        y, words = self.vectors(rows), rows.ravel()
        order = np.argsort(self.feature[words], kind="stable")
        feature = self.feature[words][order]
        first = np.flatnonzero(np.diff(feature, prepend=-1))
        weighted = y[order // rows.shape[1]] * self.idf[words[order], None]
        return feature[first], np.add.reduceat(weighted, first, axis=0) if len(first) else weighted


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


#: Features of one row that a task of the fit sends.
_FEATURE_BLOCK = 512


def _gram_product(space: Space, n: int):
    """Partial sums of A'A times the basis over the passages A of the documents given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(space.basis.shape)
        for pdf in batches:
            for raw in pdf["ids"]:
                ids = _unpacked(raw)
                padded = np.concatenate((ids, np.full(2 * n, -1, np.int32)))
                at = _passages(ids, n, n)
                for a in range(0, len(at), 2048):
                    feature, sums = space.spread_back(padded[at[a : a + 2048, None] + np.arange(2 * n)])
                    total[feature] += sums
        blocks = [(k, total[k : k + _FEATURE_BLOCK]) for k in range(0, len(total) - 1, _FEATURE_BLOCK)]
        blocks = [(k, x.astype(np.float32).tobytes()) for k, x in blocks if x.any()]
        yield pd.DataFrame(blocks, columns=["feature", "sums"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    sums = sum(np.frombuffer(x, np.float32).astype(float) for x in pdf["sums"])
    return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "sums": [sums.astype(np.float32).tobytes()]})


def fit_space(docs: DataFrame, idf: np.ndarray, items: Items, rank: int = RANK, seed: int = 7) -> Space:
    """Right singular vectors of the TF-IDF passages: features by latent dimensions.

    Randomised range finding with power iterations.  Passages stay distributed; each
    iteration adds up one (features x directions) product, in blocks of features.
    The items' own runs are passages of the matrix too, so words that the sampled
    documents lack are spanned as well.
    """
    space = Space.of(idf)
    size = len(space.basis) - 1
    width = min(size, rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]

    def product(b: np.ndarray) -> np.ndarray:
        now = space.with_basis(b)
        parts = (
            docs.mapInPandas(_gram_product(now, items.n), "feature int, sums binary")
            .groupBy("feature").applyInPandas(_added, "feature int, sums binary").collect()
        )
        out = np.zeros(now.basis.shape)
        for r in parts:
            block = np.frombuffer(r.sums, np.float32).reshape(-1, b.shape[1])
            out[r.feature : r.feature + len(block)] += block
        for a in range(0, len(items.starts), 4096):
            feature, sums = now.spread_back(items.runs(slice(a, a + 4096)))
            out[feature] += sums
        return out[:-1]

    for _ in range(POWER):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return space.with_basis(basis @ turn[:, np.argsort(-values)[:rank]])


@dataclass
class Cells:
    """Centres of the cells, and the indexed runs in the order of their cells with the bounds of each."""

    centres: np.ndarray
    order: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, items: Items, space: Space, seed: int = 5) -> Cells:
        """Spherical k-means on a sample of the runs; every run goes to its nearest centre."""
        runs, rng = len(items.starts), np.random.default_rng(seed)
        k = min(MOST_CELLS, max(1, runs // CELL_RUNS))
        sample = _normed(space.vectors(items.runs(np.sort(rng.permutation(runs)[:CELL_SAMPLE]))))
        centres = sample[rng.permutation(len(sample))[:k]]
        for _ in range(6):
            near = _nearest(sample, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, sample)
            centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _normed(sums), centres)
        cell = np.concatenate([_nearest(_normed(space.vectors(items.runs(slice(a, a + 4096)))), centres) for a in range(0, runs, 4096)])
        order = np.argsort(cell, kind="stable")
        return cls(centres.astype(np.float32), order, np.searchsorted(cell[order], np.arange(len(centres) + 1)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])


def common_subsequence(where: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and an item of ``size`` words.

    ``where`` has a bit for each place of a word in the item.
    """
    full = (1 << size) - 1
    v = full
    for x in words:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places_of_words(own: np.ndarray) -> dict[int, int]:
    where: dict[int, int] = {}
    for k, x in enumerate(own.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    return where


def kept_share(own: np.ndarray, where: dict[int, int], ids: np.ndarray, places: list[int], n: int, marks: np.ndarray, least: float = 0.0) -> float:
    """The best share of the item's words that is kept in order around one of ``places``; 0 if under ``least``.

    No more words can be kept around a place than stand there, so places with the most of the
    item's words come first and one that cannot beat the best found is not looked at.  ``marks``
    is false for every word number, and for -1 behind them; it is left so.
    """
    marks[own] = True
    hits = np.flatnonzero(marks[ids])
    marks[own] = False
    at = np.array(places)
    low, high = np.searchsorted(hits, at - len(own)), np.searchsorted(hits, at + 2 * n + len(own))
    best, need = 0, least * len(own)
    for k in np.argsort(low - high, kind="stable").tolist():
        most = min(int(high[k] - low[k]), len(own))
        if most <= best or most < need:
            break
        best = max(best, common_subsequence(where, len(own), ids[hits[low[k] : high[k]]].tolist()))
    return best / len(own) if best >= need else 0.0


def shared_runs(ids: np.ndarray, items: Items, grams: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> dict[int, int]:
    """Words of the longest run of n or more that ``ids`` shares with each of the items ``wanted``, if any."""
    table, places = grams
    own = gram_hashes(ids, items.n)
    low = np.searchsorted(table, own)
    hit = np.flatnonzero((low < len(table)) & (table[np.minimum(low, len(table) - 1)] == own)) if len(table) else low[:0]
    best: dict[int, int] = {}
    open_runs: dict[int, tuple[int, int, int]] = {}
    # Doc places a few at a time: a repeated word may meet as many places of an item.
    for a in range(0, len(hit), 4096):
        at = hit[a : a + 4096]
        many = np.searchsorted(table, own[at], "right") - low[at]
        i = np.repeat(at, many)
        j = places[np.repeat(low[at] - np.cumsum(many) + many, many) + np.arange(len(i))]
        k = np.searchsorted(items.bounds, j, "right") - 1
        keep = np.isin(k, wanted)
        i, j, k = i[keep], j[keep], k[keep]
        if not len(i):
            open_runs = {}
            continue
        order = np.lexsort((i, j - i))
        i, j, k = i[order], j[order], k[order]
        first = np.flatnonzero((np.diff(j - i, prepend=np.iinfo(np.int64).min // 2) != 0) | (np.diff(i, prepend=-2) != 1) | (np.diff(k, prepend=-1) != 0))
        last = np.append(first[1:], len(i)) - 1
        going: dict[int, tuple[int, int, int]] = {}
        for f, e in zip(first.tolist(), last.tolist(), strict=True):
            start, item, shift = int(i[f]), int(k[f]), int(j[f] - i[f])
            # A run may have begun in the places before.
            if (begun := open_runs.get(shift)) is not None and begun[1] == start - 1 and begun[2] == item:
                start = begun[0]
            end = int(i[e])
            if np.array_equal(ids[start : end + items.n], items.flat[start + shift : end + shift + items.n]):
                best[item] = max(best.get(item, 0), end - start + items.n)
            going[shift] = (start, end, item)
        open_runs = going
    return best


def has_answer(ids: np.ndarray, answer: np.ndarray, places: list[int], reach: int) -> bool:
    """Whether the words of ``answer`` stand together within ``reach`` words of one of ``places``."""
    size = len(answer)
    for place in places:
        near = ids[max(0, place - reach) : place + reach]
        if len(near) >= size and (np.lib.stride_tricks.sliding_window_view(near, size) == answer).all(1).any():
            return True
    return False


def _near_pairs(v: np.ndarray, least: np.ndarray, items: Items, space: Space, cells: Cells, tiles: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, cosine) of all passages ``v`` and items with a run of cosine ``least`` or more in the nearest cells."""
    k = min(PROBES, len(cells.centres))
    probed = []
    for a in range(0, len(v), 4096):
        near = v[a : a + 4096] @ cells.centres.T
        probed.append(np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1)))
    cell = np.concatenate(probed).ravel()
    by_cell = np.argsort(cell, kind="stable")
    passage, edge = by_cell // k, np.searchsorted(cell[by_cell], np.arange(len(cells.centres) + 1))
    found = []
    for a in range(0, len(cells.order), RUN_TILE):
        b = min(a + RUN_TILE, len(cells.order))
        # The vectors of a single tile are kept, those of several are made anew for each batch.
        runs = tiles[0] if tiles else np.empty((b - a, space.basis.shape[1]), np.float32)
        for k in range(a, b if not tiles else a, 16_384):
            runs[k - a : k - a + 16_384] = _normed(space.vectors(items.runs(cells.order[k : min(k + 16_384, b)])))
        if not tiles and len(cells.order) <= RUN_TILE:
            tiles.append(runs)
        for c in range(int(np.searchsorted(cells.bounds, a, "right")) - 1, int(np.searchsorted(cells.bounds, b))):
            p = passage[edge[c] : edge[c + 1]]
            low, high = max(a, cells.bounds[c]), min(b, cells.bounds[c + 1])
            step = max(1, 2_000_000 // max(1, high - low))
            for at in range(0, len(p) if low < high else 0, step):
                some = p[at : at + step]
                near = v[some] @ runs[low - a : high - a].T
                i, j = np.nonzero(near >= least[some, None])
                if len(i):
                    found.append(_best_of(some[i], items.run_item[cells.order[low + j]], near[i, j], len(items.ids)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), len(items.ids))


def _best_of(passage: np.ndarray, item: np.ndarray, cosine: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per passage and item, with the highest cosine."""
    order = np.lexsort((-cosine, passage * items + item))
    first = order[np.flatnonzero(np.diff((passage * items + item)[order], prepend=-1))]
    return passage[first], item[first], cosine[first]


def _candidates(docs: list[np.ndarray], items: Items, space: Space, cells: Cells, tiles: list, cosine: float, rewordings: bool):
    """(document, [(item, cosine, places of the passages above ``PARAPHRASE_COSINE``)]) of all documents with a near passage.

    A passage with fewer than n item words holds no verbatim run, so it counts from ``PARAPHRASE_COSINE`` on.
    """
    n = items.n
    at = [_passages(ids, n, 1 if rewordings else n) for ids in docs]
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in at])
    if not len(owner):
        return
    # One array of all documents; none of its passages reaches into the next document.
    shift = np.concatenate(([0], np.cumsum([len(ids) + 2 * n for ids in docs])))
    every = np.full(shift[-1], -1, np.int32)
    for k, ids in enumerate(docs):
        every[shift[k] : shift[k] + len(ids)] = ids
    place = np.concatenate(at)
    rows = every[(place + shift[owner])[:, None] + np.arange(2 * n)]
    least = np.where((rows >= 0).sum(1) >= n, cosine, max(cosine, PARAPHRASE_COSINE))
    p, item, c = _near_pairs(_normed(space.vectors(rows)), least, items, space, cells, tiles)
    if not len(p):
        return
    order = np.lexsort((place[p], -c, item, owner[p]))
    doc, item, c, place = owner[p][order], item[order], c[order], place[p][order]
    best = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    now, pairs = -1, []
    for a, b in zip(best.tolist(), np.append(best[1:], len(doc)).tolist(), strict=True):
        if doc[a] != now:
            if pairs:
                yield now, pairs
            now, pairs = int(doc[a]), []
        # The best passage always counts, as a verbatim run may be near it.
        pairs.append((int(item[a]), float(c[a]), [int(x) for x in (place[a], *place[a + 1 : b][c[a + 1 : b] >= PARAPHRASE_COSINE])]))
    if pairs:
        yield now, pairs


def _search(items: Items, space: Space, cells: Cells, cosine: float, rewordings: bool, least_kept: float):
    n = items.n
    where: dict[int, dict[int, int]] = {}
    marks = np.zeros(len(items.vocabulary) + 1, bool)

    def checked(ids: np.ndarray, pairs: list[tuple], grams: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
        longest = {} if not len(_passages(ids, n, n)) else shared_runs(ids, items, grams, np.array([k for k, _, _ in pairs]))
        for k, c, places in pairs:
            run_words = longest.get(k, 0)
            if run_words or (rewordings and c >= PARAPHRASE_COSINE):
                own, answer = items.words(k), items.answers[k]
                if rewordings and k not in where:
                    where[k] = places_of_words(own)
                kept = kept_share(own, where[k], ids, places, n, marks, 0.0 if run_words else least_kept) if rewordings else None
                if not run_words and kept < least_kept:
                    continue
                yield items.ids[k], c, run_words, kept, None if answer is None else has_answer(ids, answer, places, 2 * n + len(own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, tiles = items.grams(), []
        for pdf in batches:
            idents, raws = pdf["ident"].tolist(), pdf["ids"].tolist()
            a = 0
            while a < len(raws):
                docs, size = [], 0
                while a + len(docs) < len(raws) and (not docs or size < BATCH_WORDS):
                    docs.append(_unpacked(raws[a + len(docs)]))
                    size += len(docs[-1])
                out = [
                    (row[0], idents[a + d], *row[1:])
                    for d, pairs in _candidates(docs, items, space, cells, tiles, cosine, rewordings) for row in checked(docs[d], pairs, grams)
                ]
                if out:
                    yield pd.DataFrame(out, columns=["item", "ident", "cosine", "run_words", "kept", "answered"], dtype=object)
                a += len(docs)

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, ident: str, text: str, item_ident: str, item_text: str,
    min_words: int = 12, cosine: float = COSINE, rewordings: bool = True, item_answer: str | None = None, least_kept: float = 0.0,
) -> DataFrame:
    """Pairs of item and document that share a run of words or are near in meaning.

    Result: ``item``, ``ident``, ``cosine`` (of the document's best passage to the item's
    best run), ``run_words`` (longest run of at least ``min_words`` consecutive words of the
    item, else 0), ``kept`` (longest common subsequence around any passage above
    ``PARAPHRASE_COSINE`` as a share of the item's words) and ``answered`` (whether the item's
    ``item_answer`` stands near one of these passages, null for an item without one).
    Candidates without such a run and with a cosine under ``PARAPHRASE_COSINE`` or ``kept`` under
    ``least_kept`` are left out.
    Without ``rewordings`` only shared runs are looked for, which costs far less, and ``kept`` is null.

    Letter case, punctuation, markup, line breaks, cue numbers, cue timing and look-alike
    characters between and in words don't matter.  Null texts hold nothing, items of fewer
    words than ``min_words`` are not searched for, and repeated rows count once.  Items,
    held-out texts written by hand, reach the driver and every task; documents never do.
    A task holds the vectors of ``RUN_TILE`` item runs at a time, so memory doesn't grow with
    the number of items but for their word numbers.
    """
    spark = docs.sparkSession
    answer = F.col(item_answer) if item_answer else F.lit(None)
    rows = items.select(F.col(item_ident).alias("i"), F.col(item_text).alias("t"), answer.cast("string").alias("a")).where("i is not null and t is not null").distinct().orderBy("i", "t", "a").collect()
    bank = Items.of([tuple(r) for r in rows], min_words)
    kinds = {"item": items.schema[item_ident].dataType.simpleString(), "ident": docs.schema[ident].dataType.simpleString()}
    schema = f"item {kinds['item']}, ident {kinds['ident']}, cosine double, run_words int, kept double, answered boolean"
    if not len(bank.starts):
        return spark.createDataFrame([], schema)
    corpus = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where("ident is not null and text is not null")
    size = len(bank.vocabulary)
    scanned = cut(spread(corpus).mapInPandas(_scan(bank.vocabulary, min_words, rewordings), f"ident {kinds['ident']}, ids binary, word int, n long"))
    stats = scanned.where("word >= 0").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size + 1)
    counts[stats["word"]] = stats["n"]
    # A word of every passage keeps a little weight, so that no item has none at all.
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + LEAST_IDF
    found = scanned.where("ids is not null").select("ident", "ids", "n")
    # The fit takes every m-th candidate document by hash, so that about FIT_DOCUMENTS remain.
    dense = found.where("n = 1").drop("n")
    m = max(1, -(-dense.count() // FIT_DOCUMENTS))
    sample = cut(dense.where(F.pmod(F.xxhash64("ident"), F.lit(m)) == 0).repartition(FIT_TASKS))
    space = fit_space(sample, idf, bank)
    out = found.drop("n").mapInPandas(_search(bank, space, Cells.of(bank, space), cosine, rewordings, least_kept), schema)
    best = [F.max(c).alias(c) for c in ("cosine", "run_words", "kept", "answered")]
    return out.groupBy("item", "ident").agg(*best)
