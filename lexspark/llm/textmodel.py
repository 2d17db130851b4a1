"""Hashed text features and the two linear models that are trained on them."""

from __future__ import annotations

import re
import tempfile
import zlib
from collections import Counter
from itertools import groupby

import numpy as np

BITS = 18
SIZE = 1 << BITS
#: Features that the training of a model handles at once; a longer row is a part of its own.
PART = 1 << 18
_WORDS = re.compile(r"[^\W\d_]+")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SIZE - 1)


class WordFeatures:
    """Hashed words and first characters of words, counted over the distinct words of a text.

    The value of a slot is log(1 + number of distinct words that have it). Each task keeps one table of the
    words it knows.
    """

    def __init__(self, keep: np.ndarray | None = None, most: int = 200_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.keep, self.most = keep, most

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = (_slot("w:" + word), *(_slot(f"p{k}:{word[:k]}") for k in (3, 4, 5, 6, 7) if len(word) > k))
            if self.keep is not None:
                got = tuple(s for s in got if self.keep[s])
            if len(word) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.of_words(words_of(text))

    def of_words(self, words: set[str]) -> tuple[np.ndarray, np.ndarray]:
        all_: list[int] = []
        for w in words:
            all_ += self.of_word(w)
        slots, counts = np.unique(np.array(all_, dtype=np.int32), return_counts=True)
        return slots, np.log1p(counts).astype(np.float32)


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def _shape(token: str) -> str:
    """Classes of all characters with runs collapsed: 'Word,' -> 'Aa,', '12%' -> '0%'; a shape of more than 24
    classes is named by its hash."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    shape = "".join(k for k, _ in groupby(kinds))
    return shape if len(shape) <= 24 else f"#{zlib.crc32(shape.encode('utf-8', 'surrogatepass')):08x}"


class ShapeFeatures:
    """Hashed words, word shapes, shape pairs and repetition of a text, as (slots, values).

    Two blocks of unit length: words by presence, and shapes by the root of their share of the tokens.
    Repetition is measured on whole texts: shares of tokens equal to the one before, of repeated words and
    of repeated lines, in steps.
    """

    def __init__(self, most: int = 200_000):
        self.known: dict[str, str] = {}
        self.slots: dict[str, int] = {}
        self.most = most

    def _slot(self, name: str) -> int:
        s = self.slots.get(name)
        if s is None:
            s = _slot(name)
            if len(self.slots) >= self.most:
                self.slots.clear()
            self.slots[name] = s
        return s

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        tokens = text.split()
        n = len(tokens)
        if not n:
            return np.array([self._slot("empty")], dtype=np.int32), np.ones(1, dtype=np.float32)
        if len(self.known) > self.most:
            self.known.clear()
        words = Counter(tokens)
        shape = {}
        for w in words:
            s = self.known.get(w)
            if s is None:
                s = _shape(w)
                if len(w) <= 64:
                    self.known[w] = s
            shape[w] = s
        shapes: Counter = Counter()
        for w, k in words.items():
            shapes[shape[w]] += k
        seq = [shape[w] for w in tokens]
        pairs = Counter(zip(seq, seq[1:], strict=False))
        same = sum(map(str.__eq__, tokens, tokens[1:])) / n
        lines = [x for x in text.split("\n") if x.strip()]
        tell = {"same": same, "repeated": 1 - len(words) / n, "lines": 1 - len(set(lines)) / max(1, len(lines)), "short": 1 / n}
        block: dict[str, float] = {f"s:{s}": (k / n) ** 0.5 for s, k in shapes.items()}
        block |= {f"b:{a} {b}": (k / n) ** 0.5 for (a, b), k in pairs.items()}
        steps = {f"{name}>{t}": 1.0 for name, x in tell.items() for t in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7) if x > t}
        bag = 1 / len(words) ** 0.5
        names = [*((f"w:{w.lower()}", bag) for w in words), *block.items(), *steps.items()]
        return np.fromiter((self._slot(a) for a, _ in names), np.int32, len(names)), np.fromiter((v for _, v in names), np.float32, len(names))


class Rows:
    """A sparse matrix by rows: slots and values of all rows, one after another, in memory or in mapped files."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.slots = np.concatenate(slots).astype(np.int32) if slots else np.zeros(0, np.int32)
        self.values = np.ones(len(self.slots), np.float32) if values is None or not values else np.concatenate(values).astype(np.float32)
        self._places([len(s) for s in slots])

    def _places(self, sizes: list[int]) -> None:
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pick(self, k: list[int]) -> Rows:
        """The rows k; slots and values are shared."""
        got = Rows([])
        got.slots, got.values, got.sizes, got.starts = self.slots, self.values, self.sizes[k], self.starts[k]
        return got

    def without(self, dead: np.ndarray) -> Rows:
        """The rows without the features of dead slots, in files."""
        kept = RowFile()
        for at, n in zip(self.starts, self.sizes, strict=True):
            s = self.slots[at : at + n]
            live = ~dead[s]
            kept.add(s[live], self.values[at : at + n][live])
        return kept.rows()

    def parts(self, k: np.ndarray):
        """(from, to, row numbers in the part, slots, values) of the rows k, some rows with at most PART features at a time."""
        ends, low = np.cumsum(self.sizes[k]), 0
        while low < len(k):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + PART, side="right")))
            at = np.concatenate([np.arange(self.starts[i], self.starts[i] + self.sizes[i]) for i in k[low:high]])
            yield low, high, np.repeat(np.arange(high - low), self.sizes[k[low:high]]), self.slots[at], self.values[at]
            low = high

    def dot(self, w: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Sum of weight * value of each of the rows k."""
        z = np.zeros(len(k))
        for low, high, r, s, v in self.parts(k):
            z[low:high] = np.bincount(r, w[s] * v, minlength=high - low)
        return z

    def spread(self, e: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Sum of e * value at each slot over the rows k, added row by row."""
        g = np.zeros(SIZE)
        for low, high, r, s, v in self.parts(k):
            x = e[low:high][r] * v
            if low == 0 and len(s):
                g = np.bincount(s, x, minlength=SIZE)
            else:
                np.add.at(g, s, x)
        return g


class RowFile:
    """Takes rows one at a time into unnamed temporary files, which rows() maps: memory is needed for what is read."""

    def __init__(self):
        self.sizes: list[int] = []
        self.files = [(tempfile.TemporaryFile(), kind) for kind in (np.int32, np.float32)]

    def add(self, slots: np.ndarray, values: np.ndarray) -> None:
        for (file, kind), x in zip(self.files, (slots, values), strict=True):
            file.write(np.ascontiguousarray(x, dtype=kind))
        self.sizes.append(len(slots))

    def rows(self) -> Rows:
        got, n = Rows([]), sum(self.sizes)
        got._places(self.sizes)
        for file, _ in self.files:
            file.flush()
        if n:
            got.slots, got.values = (np.asarray(np.memmap(file, kind, "r", shape=(n,))) for file, kind in self.files)
        for file, _ in self.files:
            file.close()
        return got


def rare(rows: Rows, least: int) -> np.ndarray:
    """Slots met in fewer than `least` rows."""
    n = np.zeros(SIZE, np.int64)
    for i in range(0, len(rows.slots), PART):
        n += np.bincount(rows.slots[i : i + PART], minlength=SIZE)
    return n < least


def fit_logistic(rows: Rows, y: np.ndarray, pairs: tuple[Rows, Rows] | None = None, fair: float = 1.0, weight: float = 3.0, epochs: int = 40, rate: float = 0.15, l2: float = 5e-3, least: int = 8, seed: int = 42) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by AdaGrad; rows with label 1 count `weight` times.

    pairs: features of texts and of the same texts with their identity terms swapped. Each pair adds
    fair * (score - swapped score)^2 / 2, so weights that tell groups apart shrink.
    """
    rng, w, g2 = np.random.default_rng(seed), np.zeros(SIZE), np.full(SIZE, 1e-6)
    dead = rare(rows, least)
    rows, pairs = rows.without(dead), pairs and (pairs[0].without(dead), pairs[1].without(dead))  # their weights stay zero
    p0 = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    b, b2 = float(np.log(p0 / (1 - p0))), 1e-6
    n_pairs = len(pairs[0].sizes) if pairs else 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 256):
            k = order[i : i + 256]
            z = rows.dot(w, k) + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]) * np.where(y[k] > 0, weight, 1.0) / len(k)
            g = rows.spread(e, k)
            if n_pairs:
                q = rng.integers(0, n_pairs, min(64, n_pairs))
                d = fair * (pairs[0].dot(w, q) - pairs[1].dot(w, q)) / len(q)
                g += pairs[0].spread(d, q) - pairs[1].spread(d, q)
            g += l2 * w
            g[dead] = 0
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gb = float(e.sum())
            b2 += gb * gb
            b -= rate * gb / b2**0.5
    return w, b


def fit_ordinal(rows: Rows, grade: np.ndarray, grades: int, epochs: int = 12, rate: float = 0.15, l2: float = 1e-4, least: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link (proportional-odds) model.

    P(grade <= k) = sigmoid(threshold_k - score) with one shared weight vector. The thresholds stay ordered:
    the first is free, the others add exp() of a free step.
    """
    rng, w, g2 = np.random.default_rng(seed), np.zeros(SIZE), np.full(SIZE, 1e-6)
    dead, m = rare(rows, least), grades - 1
    rows = rows.without(dead)  # their weights stay zero
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:m] / max(1, len(grade)), 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    f2 = np.full(m, 1e-6)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for i in range(0, len(order), 256):
            k = order[i : i + 256]
            z, t = rows.dot(w, k), thresholds(free)
            up = np.concatenate([t, [np.inf]])[grade[k]]
            low = np.concatenate([[-np.inf], t])[grade[k]]
            a, c = sig(up - z), sig(low - z)
            p = np.maximum(a - c, 1e-12)
            da, dc = a * (1 - a) / p / len(k), c * (1 - c) / p / len(k)
            e = da - dc  # derivative of -log p by the score
            g = rows.spread(e, k) + l2 * w
            g[dead] = 0
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gt = np.zeros(m)
            np.add.at(gt, grade[k][grade[k] < m], -da[grade[k] < m])
            np.add.at(gt, grade[k][grade[k] > 0] - 1, dc[grade[k] > 0])
            gf = np.array([gt[j:].sum() * (1 if j == 0 else np.exp(free[j])) for j in range(m)])
            f2 += gf * gf
            free = free - rate * gf / np.sqrt(f2)
    return w, thresholds(free)


def thresholds(free: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
