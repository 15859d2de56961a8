"""Hashed n-grams of texts, and logistic regression over them with calibrated probabilities."""

from __future__ import annotations

import numpy as np

from .shared import Texts, combined, mixed, runs

_M = np.uint32(0x9E3779B1)


def char_buckets(texts: Texts, n: int, bits: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the byte n-gram at each position, and the mask of positions whose n-gram lies within one text.

    A text is hashed whole; one with under n bytes has none.
    """
    data = texts.bytes.astype(np.uint32)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
    count = max(0, len(data) - n + 1)
    h = np.zeros(count, np.uint32)
    for j in range(n):
        h *= _M
        h += data[j : j + count] + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    inside = np.ones(count, bool)
    for j in range(1, n):  # n-grams that reach over the end of a text
        at = texts.bounds[1:-1] - j
        inside[at[(at >= 0) & (at < count)]] = False
    return (h >> np.uint32(32 - bits)).astype(np.int32), inside


def _chars(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point (its UTF-8 bytes), and the bounds of the texts among them."""
    data = texts.bytes
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return data.astype(np.uint32), texts.bounds
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(data)))
    four = np.ndarray(len(data) + 1, "<u4", buffer=texts.loads().base, strides=(1,))
    return four[at] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[size], np.searchsorted(at, texts.bounds)


def buckets(texts: Texts, bits: int, chars: tuple[int, ...], words: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hash buckets (2**bits of its own, numbered on from the order before) of all n-grams of code
    points, then of words, text by text, and the bounds of the texts among them. Texts are hashed whole."""
    out = []
    values, bounds = _chars(texts)
    points = mixed(values.astype(np.uint64) + np.uint64(1))
    tokens = None
    for n, unit in [(n, "char") for n in chars] + [(n, "word") for n in words]:
        if unit == "word" and tokens is None:
            starts, ends, first = texts.words()
            tokens = texts.hashes(starts, ends)
        items, ends_at = (points, bounds) if unit == "char" else (tokens, first)
        h = items if n == 1 else combined(items, n)
        room = np.maximum(np.diff(ends_at) - (n - 1), 0)
        if n > 1:  # n-grams that reach over the end of a text go
            h = h[runs(ends_at[:-1], room)]
        out.append(((h >> np.uint64(64 - bits)).astype(np.int32) + np.int32(len(out) << bits), np.concatenate([[0], np.cumsum(room)])))
    return out


def margins(texts: Texts, weights: np.ndarray, bits: int, chars: tuple[int, ...], words: tuple[int, ...]) -> np.ndarray:
    """The model's value of each text, apart from the bias: over the orders, the mean weight of the text's n-grams."""
    out = np.zeros(texts.n)
    for bucket, bounds in buckets(texts, bits, chars, words):
        size = np.diff(bounds)
        some = np.flatnonzero(size)
        if len(some):
            out[some] += np.add.reduceat(weights[bucket].astype(np.float64), bounds[some]) / size[some]
    return out


def shares(texts: Texts, bits: int, chars: tuple[int, ...], words: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets (ascending) and their shares of the n-grams of their order, of each text."""
    parts = buckets(texts, bits, chars, words)
    out = []
    for i in range(texts.n):
        found = [np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True) for bucket, bounds in parts]
        out.append((np.concatenate([b for b, _ in found]), np.concatenate([(n / max(1, n.sum())).astype(np.float32) for _, n in found])))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 6, batch: int = 64, rate: float = 3.0, penalty: float = 1e-6, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression over sparse rows (buckets, values), both labels weighing alike.

    Adaptive gradient steps over shuffled batches (deterministic); a step touches the buckets of its batch only.
    """
    w, square = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32)
    b, b_square, rng = 0.0, 1e-6, np.random.default_rng(seed)
    weight = np.ones(len(y))
    if 0 < y.sum() < len(y):
        weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            some = order[i : i + batch]
            sizes = np.array([len(rows[k][0]) for k in some])
            at, x = (np.concatenate([rows[k][j] for k in some]) for j in (0, 1))
            owner = np.repeat(np.arange(len(some)), sizes)
            z = np.bincount(owner, weights=w[at] * x, minlength=len(some)) + b
            error = weight[some] * (sigmoid(z) - y[some]) / len(some)
            touched, index = np.unique(at, return_inverse=True)
            g = np.bincount(index, weights=error[owner] * x).astype(np.float32) + np.float32(penalty) * w[touched]
            square[touched] += g * g
            w[touched] -= np.float32(rate) * g / np.sqrt(square[touched])
            g_b = float(error.sum())
            b_square += g_b * g_b
            b -= rate * g_b / b_square**0.5
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, steps: int = 60, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of a probability sigmoid(slope * score + shift), by Newton steps on smoothed labels of rows of a weight."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g, v = weight * (p - goal), weight * (p * (1 - p) + 1e-9)
        h11, h12, h22 = (v * score * score).sum() + 1e-6, (v * score).sum(), v.sum() + 1e-6
        g1, g2 = (g * score).sum() + 1e-6 * (a - 1), g.sum()
        det = h11 * h22 - h12 * h12
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return a, b
