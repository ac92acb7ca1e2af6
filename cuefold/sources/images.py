"""Pixel work on glyph images: NumPy only, one image in, one image out."""

from __future__ import annotations

import numpy as np

# Fixed values of the preparations.
BORDER, DARK_MEAN, THRESHOLD, HOLLOW_SCALE, HOLLOW_AREA = 24, 0.5, 0.94, 4, 6000


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb @ np.array([0.2126, 0.7152, 0.0722]) + 0.5).astype(np.uint8)


def histogram(image: np.ndarray) -> np.ndarray:
    return np.bincount(image.ravel(), minlength=256)


def is_blank(image: np.ndarray) -> bool:
    """Whether the gray values hardly differ."""
    return float(image.std()) / 255 <= 0.001


def trim(image: np.ndarray) -> np.ndarray:
    """Without the border of the colour of the top left pixel."""
    rows, cols = np.nonzero(image != image[0, 0])
    return image[rows.min() : rows.max() + 1, cols.min() : cols.max() + 1] if len(rows) else image


def prepare_frame(image: np.ndarray) -> np.ndarray:
    """Trimmed, with a border that is black around dark images and white around light ones."""
    core = trim(image)
    return np.pad(core, BORDER, constant_values=0 if core.mean() / 255 < DARK_MEAN else 255)


def _around(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    padded = np.pad(mask, reach)
    out = np.zeros_like(mask)
    h, w = mask.shape
    for a, b in offsets:
        out |= padded[reach + a : reach + a + h, reach + b : reach + b + w]
    return out


def disk(radius: float) -> list[tuple[int, int]]:
    r = int(np.ceil(radius))
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= radius * radius]


def dilate(mask: np.ndarray, radius: float = 1.0) -> np.ndarray:
    return _around(mask, disk(radius))


def erode(mask: np.ndarray, radius: float) -> np.ndarray:
    return ~_around(~mask, disk(radius))


def threshold_dilate(image: np.ndarray) -> np.ndarray:
    """Light pixels, thickened, as white on black."""
    return np.where(dilate(image >= THRESHOLD * 255), 255, 0).astype(np.uint8)


def band(image: np.ndarray, low: int, high: int) -> np.ndarray:
    """Pixels between two percents as black on white."""
    v = image / 255 * 100
    return np.where((v > low) & (v <= high), 0, 255).astype(np.uint8)


def above(image: np.ndarray, percent: int) -> np.ndarray:
    """Pixels above a percent as black on white."""
    return np.where(image / 255 * 100 > percent, 0, 255).astype(np.uint8)


def resize(image: np.ndarray, factor: int) -> np.ndarray:
    return np.repeat(np.repeat(image, factor, 0), factor, 1)


def auto_level(image: np.ndarray) -> np.ndarray:
    lo, hi = int(image.min()), int(image.max())
    return image if lo == hi else np.round((image.astype(float) - lo) / (hi - lo) * 255).astype(np.uint8)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected areas, by rows of runs joined upwards."""
    labels, parent = np.zeros(mask.shape, np.int64), [0]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above_runs: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.diff(np.concatenate(([0], row.astype(np.int8), [0])))
        runs = []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            label = 0
            for pa, pb, k in above_runs:
                if pa <= b and pb >= a:
                    if label:
                        parent[root(k)] = root(label)
                    else:
                        label = root(k)
            if not label:
                label = len(parent)
                parent.append(label)
            labels[y, a:b] = label
            runs.append((int(a), int(b), label))
        above_runs = runs
    flat = np.array([root(k) for k in range(len(parent))])
    return flat[labels]


def fill_hollow(image: np.ndarray) -> np.ndarray:
    """Interiors of outlined glyphs as black on white: small light areas enclosed by dark lines."""
    big = resize(image, HOLLOW_SCALE)
    light = big > 0.55 * 255
    labels = components(light)
    sizes = np.bincount(labels.ravel())
    inner = light & (sizes[labels] < HOLLOW_AREA)
    return np.where(dilate(inner, 1.5), 0, 255).astype(np.uint8)
