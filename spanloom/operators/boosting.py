"""Boosted trees, logistic and pairwise linear scores in numpy, of all rows of a fit, which one task holds.

Features are not negative and mostly zero, so only what isn't zero is stored: as codes of a row, the places of its values
among the features' cuts. A split sends to the right the rows whose value is beyond a cut. Of two children only the one
with fewer rows is summed up by code, the other is what is left of their parent; nodes too light to be split aren't.
``trees.java`` grows the same trees in Spark's executors (``packed``, ``grown``, ``taken``).
"""

from __future__ import annotations

import itertools
import struct
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa


class Sparse(NamedTuple):
    """A matrix by what isn't zero: row, column and value of each entry."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, x: np.ndarray | Sparse) -> Sparse:
        """Of a dense one; only what is greater than zero counts."""
        if isinstance(x, Sparse):
            return x
        row, col = np.nonzero(x > 0)
        return cls(row, col, x[row, col], x.shape)

    def beside(self, other: Sparse) -> Sparse:
        return Sparse(np.r_[self.row, other.row], np.r_[self.col, other.col + self.shape[1]], np.r_[self.value, other.value], (self.shape[0], self.shape[1] + other.shape[1]))


#: entries that are ordered or counted at a time, so that what this takes beside them stays small
_STRETCH = 1 << 22


def _counts(a: np.ndarray, n: int) -> np.ndarray:
    return sum((np.bincount(a[i : i + _STRETCH], minlength=n) for i in range(0, len(a), _STRETCH)), np.zeros(n, dtype=np.int64))


class Cuts:
    """Codes of features' values: at most ``bins`` for each feature (four for the first ``coarse`` ones), by the quantiles of what
    isn't zero in the sample."""

    def __init__(self, x: np.ndarray | Sparse, most: int = 16, coarse: int = 0, rows: float = 0):
        """``rows``: cuts with fewer rows of the sample beyond them are left out."""
        x = Sparse.of(x)
        row, col = x.row, x.col
        count = _counts(col, x.shape[1])
        ends = np.cumsum(count)
        #: the entries by row: what row and feature, and the place among the feature's cuts, -1 without any
        self.row, self.col, bins = row, col, np.full(len(row), -1, dtype=np.int8)
        cuts, low = [], 0
        while low < len(count):  # some features at a time
            high = max(int(np.searchsorted(ends, ends[low] - count[low] + _STRETCH, side="right")), low + 1)
            order = np.flatnonzero((col >= low) & (col < high))
            own_col = col[order] - low
            order = order[np.argsort(own_col.astype(np.uint16) if high - low < 1 << 16 else own_col, kind="stable")]
            values, own_ends = x.value[order], np.cumsum(count[low:high])
            for f, begin, end in zip(range(low, high), np.append(0, own_ends[:-1]), own_ends):
                if end - begin < max(rows, 1):
                    cuts.append(values[:0])
                    continue
                bin_count, own = most if f >= coarse else 4, values[begin:end]
                seen = np.unique(own)
                if len(seen) > bin_count:
                    seen = np.unique(seen[np.floor(np.arange(bin_count) / bin_count * (len(seen) - 1)).astype(int)])
                at = np.searchsorted(seen, own, side="right") - 1
                kept = int((np.cumsum(np.bincount(at, minlength=len(seen))[::-1])[::-1] >= rows).sum())
                cuts.append(seen[:kept])
                bins[order[begin:end]] = np.minimum(at, kept - 1)
            low = high
        self.bin = bins
        self._place(cuts)

    def _place(self, cuts: list[np.ndarray]) -> None:
        self.cuts = cuts
        sizes = np.array([len(c) for c in self.cuts], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.repeat(np.cumsum(sizes) - 1, sizes)  # of each code, the greatest code of its feature

    @classmethod
    def of(cls, cuts: list[np.ndarray]) -> Cuts:
        made = cls.__new__(cls)
        made._place(cuts)
        return made

    def places(self, x: Sparse) -> np.ndarray:
        """Of each entry, the place of its value among its feature's cuts, from 1 on; 0 below the least."""
        wide = np.full((max(map(len, self.cuts), default=0), len(self.cuts)), np.inf)
        for f, cuts in enumerate(self.cuts):
            wide[: len(cuts), f] = cuts
        out = np.zeros(len(x.row), dtype=np.uint8)
        for cuts in wide:
            out += cuts.take(x.col) <= x.value
        return out


def _exact(v: np.ndarray) -> np.ndarray:
    """Multiples of 2**-32, whose sums over a million rows have no rounding: equal whatever their order."""
    return np.rint(v * 2.0**32) / 2.0**32


def _short(v: np.ndarray) -> np.ndarray:
    """Multiples of 2**-22, about what single precision holds, of which ``trees.java`` sums two in one number. Splits are chosen
    by their sums; leaves have those of ``_exact``."""
    return np.rint(v * 2.0**22) / 2.0**22


class _Entries:
    """The codes of a sample's rows. They are numbered by place, then feature, those with more cuts first, so the sums of a
    feature's codes from one on are a few sums of stretches. Rows are taken in the order of their number of entries, ``order``;
    those of like many lie in one block, filled with a last number that stands for nothing."""

    def __init__(self, cuts: Cuts, n: int, blocks: int = 8):
        sizes = np.array([len(c) for c in cuts.cuts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), dtype=np.int64)
        rank[order] = np.arange(len(sizes))
        self.widths = [int((sizes > b).sum()) for b in range(sizes.max(initial=0))]  # features with more than b cuts
        first = np.cumsum([0, *self.widths])
        self.size = int(first[-1])
        self.bin = np.repeat(np.arange(len(self.widths)), self.widths)
        self.feature = order[np.arange(self.size) - first[self.bin]]
        self.code = cuts.first[self.feature] + self.bin
        held = cuts.bin >= 0
        row, col, at = cuts.row[held], cuts.col[held], cuts.bin[held].astype(np.int64)
        count = np.bincount(row, minlength=n)
        self.order = np.argsort(count, kind="stable")
        within = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        row, count = place[row], count[self.order]
        self.grid = np.zeros((len(sizes), n), dtype=np.uint8)  # places from 1 on, 0 for none
        self.grid[col, row] = at + 1
        number = first[at] + rank[col]
        self.ends, self.blocks = [], []
        for own in np.array_split(np.arange(n), blocks):
            begin, end = (own[0], own[-1] + 1) if len(own) else (n, n)
            self.ends.append(end)
            self.blocks.append(np.full((len(own), count[begin:end].max(initial=0)), self.size, dtype=np.int64))
            mine = (row >= begin) & (row < end)
            self.blocks[-1][row[mine] - begin, within[mine]] = number[mine]
        by = np.argsort(number, kind="stable")
        self.row, self.pair = row[by], np.empty(len(by), dtype=complex)
        self.start = np.searchsorted(number[by], np.arange(self.size))  # of each code, which all have entries
        most = sum(m.size for m in self.blocks)
        self.number, self.value = np.zeros(most, dtype=np.int64), np.zeros((2, most))

    def whole(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of all rows, a slot."""
        both = np.empty(len(g), dtype=complex)
        both.real, both.imag = g, h
        both.take(self.row, out=self.pair, mode="clip")
        total = np.add.reduceat(self.pair, self.start)
        return self._onward(total.real[None, :].copy()), self._onward(total.imag[None, :].copy())

    def sums(self, slot: np.ndarray, part: np.ndarray, g: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, codes) of g and of h: sums over the rows of ``part`` in each slot with the code or a later one of its feature."""
        at = slot[part]
        part, at = part[at >= 0], at[at >= 0]
        m, wide, first, begin = 0, self.size + 1, 0, 0
        ends = np.searchsorted(part, self.ends)
        vg, vh, at = g[part], h[part], at * wide
        for block, end, last in zip(self.blocks, ends, self.ends):
            # what is written again and again is not allocated anew, which would cost more than the sums
            if (k := (end - begin) * block.shape[1]) > 0:
                shape, i = (end - begin, block.shape[1]), slice(begin, end)
                number = self.number[m : m + k].reshape(shape)
                block.take(part[i] - first, axis=0, out=number, mode="clip")
                if n > 1:
                    number += at[i, None]
                self.value[0, m : m + k].reshape(shape)[:] = vg[i, None]
                self.value[1, m : m + k].reshape(shape)[:] = vh[i, None]
                m += k
            begin, first = end, last
        return tuple(self._onward(np.bincount(self.number[:m], v[:m], n * wide).reshape(n, wide)[:, : self.size]) for v in self.value)

    def _onward(self, total: np.ndarray) -> np.ndarray:
        first = np.cumsum([0, *self.widths])
        for k in range(len(self.widths) - 2, -1, -1):
            w = self.widths[k + 1]
            total[:, first[k] : first[k] + w] += total[:, first[k + 1] : first[k + 1] + w]
        return total


class Boosted:
    """Gradient-boosted trees: of one score for two classes, of one for each of more."""

    def __init__(self, *, rounds: int = 400, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, ridge: float = 1.0, least: float = 1.0, seed: int = 42):
        self.rounds, self.depth, self.rate, self.rows, self.columns, self.ridge, self.least, self.seed = rounds, depth, rate, rows, columns, ridge, least, seed
        self.splits, self.leaves = [], []

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int = 2, coarse: int = 0) -> Boosted:
        # a row's h is a quarter at most: beyond a cut with fewer rows there is never weight enough
        self.cuts, self.outputs = Cuts(x, coarse=coarse, rows=4 * self.least), 1 if classes == 2 else classes
        rng = np.random.default_rng(self.seed)
        entries = _Entries(self.cuts, len(x))
        y = y[entries.order]
        score = np.zeros((len(x), self.outputs))
        target = y[:, None].astype(float) if self.outputs == 1 else (y[:, None] == np.arange(classes)).astype(float)
        self.splits, self.leaves = [], []
        for _ in range(self.rounds):
            if self.outputs == 1:
                p = 1 / (1 + np.exp(-score))
            else:
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            drawn = (rng.random(len(x)) < self.rows)[entries.order]
            open_ = rng.random(len(self.cuts.first)) < self.columns
            part = np.flatnonzero(drawn)
            for k in range(self.outputs):
                g, h = np.where(drawn, p[:, k] - target[:, k], 0), np.where(drawn, np.maximum(p[:, k] * (1 - p[:, k]), 1e-9), 0)
                score[:, k] += self._grow(entries, part, _exact(g), _exact(h), open_)
        return self

    def packed(self, x: np.ndarray | Sparse, y: np.ndarray, classes: int = 2, coarse: int = 0) -> bytes:
        """The sample and what chance draws, for ``trees.java``, which gives the trees that ``fit`` does."""
        x = Sparse.of(x)
        self.cuts, self.outputs = Cuts(x, coarse=coarse, rows=4 * self.least), 1 if classes == 2 else classes
        cuts, n, features = self.cuts, x.shape[0], x.shape[1]
        sizes = np.array([len(c) for c in cuts.cuts], dtype=np.int64)
        rank = np.empty(features, dtype=np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(features)
        at = np.arange(len(cuts.feature)) - cuts.first[cuts.feature]
        number = (np.cumsum(np.bincount(at)) - np.bincount(at))[at] + rank[cuts.feature]  # of equal cuts the first by this counts, as in _Entries
        row, col, place = cuts.row, cuts.col, cuts.bin
        if len(row) and (row[1:] < row[:-1]).any():
            order = np.argsort(row, kind="stable")
            row, col, place = row[order], col[order], place[order]
        count, codes = np.zeros(n, dtype=np.int64), [np.zeros(0, dtype="<u2" if len(cuts.feature) <= 1 << 16 else "<i4")]
        for i in range(0, len(row), _STRETCH):
            own = slice(i, i + _STRETCH)
            held = place[own] >= 0
            count += np.bincount(row[own][held], minlength=n)
            codes.append((cuts.first[col[own][held]] + place[own][held]).astype(codes[0].dtype))
        begin = np.cumsum([0, *count])
        if (bytes_ := begin[-1] * codes[0].itemsize + self.rounds * (n + features) // 8 + 8 * n) >= 1 << 31:
            raise ValueError(f"a sample of {bytes_} bytes is more than one value can hold")
        rng = np.random.default_rng(self.seed)
        drawn, open_ = [], []
        for _ in range(self.rounds):
            drawn.append(np.packbits(rng.random(n) < self.rows, bitorder="little"))
            open_.append(np.packbits(rng.random(features) < self.columns, bitorder="little"))
        parts = (y, np.append(cuts.first, len(cuts.feature)), number, begin)
        numbers = struct.pack("<7i3d", n, self.outputs, self.rounds, self.depth, features, len(cuts.feature), begin[-1], self.rate, self.ridge, self.least)
        return b"".join([numbers, *(np.asarray(p).astype("<i4").tobytes() for p in parts), *(c.tobytes() for c in codes), *(b.tobytes() for b in drawn), *(b.tobytes() for b in open_)])

    def taken(self, trees: bytes) -> Boosted:
        """With the trees that were grown elsewhere on what ``packed`` gave."""
        kind = np.dtype([("split", "<i4", 2**self.depth - 1), ("leaf", "<f8", 2**self.depth)])
        every = np.frombuffer(trees, kind)
        self.splits, self.leaves = every["split"].astype(np.int64), every["leaf"].copy()
        return self

    def state(self) -> dict:
        """Arrays and numbers only, so that any worker can read them."""
        cuts = self.cuts.cuts
        return {"cuts": np.concatenate(cuts) if cuts else np.zeros(0), "sizes": np.array([len(c) for c in cuts], dtype=np.int64), "outputs": self.outputs, "splits": self.splits, "leaves": self.leaves, "depth": self.depth}

    @classmethod
    def of(cls, cuts: np.ndarray, sizes: np.ndarray, **rest) -> Boosted:
        made = cls(depth=rest["depth"])
        cuts = np.split(cuts, np.cumsum(sizes)[:-1]) if len(sizes) else []
        made.cuts, made.outputs, made.splits, made.leaves = Cuts.of(cuts), rest["outputs"], rest["splits"], rest["leaves"]
        return made

    def _grow(self, entries: _Entries, part: np.ndarray, g: np.ndarray, h: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The tree's values of all rows, in the order of the entries, grown on the rows of ``part``; g and h are 0 elsewhere."""
        exact_g, exact_h, g, h = g, h, _short(g), _short(h)
        rows, closed = np.arange(len(g)), np.where(open_[entries.feature], 0, -np.inf)
        node = np.zeros(len(g), dtype=np.int64)
        split = np.full(2**self.depth - 1, -1, dtype=np.int64)
        gs, hs = np.array([g.sum()]), np.array([h.sum()])
        live = np.arange(1)[(hs >= 2 * self.least) & (entries.size > 0)]  # nodes that may be split, with their sums by code
        if len(live):
            right_g, right_h = entries.whole(g, h)
        for level in range(self.depth):
            n, base = 2**level, 2**level - 1
            best = np.full(n, -1, dtype=np.int64)
            if len(live):
                best[live] = self._best(right_g, right_h, gs[live, None], hs[live, None], closed)
                cut = best >= 0
                split[base : base + n][cut] = entries.code[best[cut]]
            if (best < 0).all():
                node *= 2 ** (self.depth - level)
                break
            at = best[node]
            node = 2 * node + ((at >= 0) & (entries.grid.take(entries.feature.take(at) * len(rows) + rows) > entries.bin.take(at)))
            if level == self.depth - 1:
                break
            gs, hs = np.bincount(node, g, 2 * n), np.bincount(node, h, 2 * n)
            heavy = hs >= 2 * self.least
            kept = np.flatnonzero((best[live] >= 0) & (heavy[2 * live] | heavy[2 * live + 1]))
            count = np.bincount(node[part], minlength=2 * n)
            parent = live[kept]
            small = 2 * parent + (count[2 * parent] > count[2 * parent + 1])
            slot = np.full(2 * n, -1, dtype=np.int64)
            slot[small] = np.arange(len(small))
            if len(small):
                small_g, small_h = entries.sums(slot[node], part, g, h, len(small))
                right_g, right_h = (np.concatenate([a, b[kept] - a]) for a, b in ((small_g, right_g), (small_h, right_h)))
            live = np.concatenate([small, small ^ 1])
            if not heavy[live].all():
                right_g, right_h, live = right_g[heavy[live]], right_h[heavy[live]], live[heavy[live]]
        n = 2**self.depth
        leaf = -self.rate * np.bincount(node, exact_g, n) / (np.bincount(node, exact_h, n) + self.ridge)
        self.splits.append(split)
        self.leaves.append(leaf)
        return leaf[node]

    def _best(self, right_g: np.ndarray, right_h: np.ndarray, gs: np.ndarray, hs: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """The place of the best cut of each node, -1 where none gains."""
        left_h = hs - right_h
        light = (left_h < self.least) | (right_h < self.least)
        gain = gs - right_g
        gain *= gain
        left_h += self.ridge
        gain /= left_h
        np.multiply(right_g, right_g, out=left_h)
        left_h /= right_h + self.ridge
        gain += left_h
        gain += closed
        gain[light] = -np.inf
        best = gain.argmax(1)
        best[gain[np.arange(len(gain)), best] - (gs**2 / (hs + self.ridge))[:, 0] <= 1e-9] = -1
        return best

    def predict(self, x: np.ndarray | Sparse, chunk: int = 1024) -> np.ndarray:
        """(rows, classes): the share of each class. Rows are taken a chunk at a time, whose codes of the features in use stay at
        hand; places beyond a cut go to the right."""
        x, size = Sparse.of(x), len(self.cuts.feature)
        chunk = max(min(chunk, x.shape[0]), 1)
        n, score = x.shape[0], np.zeros((x.shape[0], self.outputs))
        splits = np.asarray(self.splits, dtype=np.int64).reshape(len(self.leaves), -1)
        used = np.unique(self.cuts.feature[splits[splits >= 0]]) if size else np.zeros(0, dtype=np.int64)
        line = np.full(x.shape[1], -1, dtype=np.int64)
        line[used] = np.arange(len(used))
        kept = np.flatnonzero(line[x.col] >= 0)
        kept = kept[np.argsort(x.row[kept], kind="stable")]
        x = Sparse(x.row[kept], x.col[kept], x.value[kept], x.shape)
        place, at = self.cuts.places(x), line[x.col] * chunk
        # a node without a split has a cut that no place is beyond
        feature = self.cuts.feature[np.maximum(splits, 0)] if size else np.zeros_like(splits)
        begin = np.where(splits >= 0, line[feature] * chunk, 0) if size else splits * 0
        beyond = np.where(splits >= 0, splits - (self.cuts.first[feature] if size else 0), 255).astype(np.uint8)
        rows = np.arange(chunk)
        for first in range(0, n, chunk):
            grid = np.zeros((len(used) + 1) * chunk, dtype=np.uint8)
            own = slice(*np.searchsorted(x.row, [first, first + chunk]))
            grid[at[own] + x.row[own] - first] = place[own]
            got = np.zeros((chunk, self.outputs))
            for i, (b, cut, leaf) in enumerate(zip(begin, beyond, self.leaves)):
                node = np.zeros(chunk, dtype=np.int64)
                for level in range(self.depth):
                    below = 2**level - 1
                    node = 2 * node + (grid.take(b[below:].take(node) + rows) > cut[below:].take(node))
                got[:, i % self.outputs] += leaf.take(node)
            score[first : first + chunk] = got[: n - first]
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-score[:, 0]))
            return np.stack([1 - p, p], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


class Logistic:
    """Scores by a linear sum and, but for ``ranks``, an intercept; the squared weights cost ``ridge`` / 2."""

    def __init__(self, *, ridge: float = 1.0, ranks: bool = False, steps: int = 100):
        self.ridge, self.ranks, self.steps = ridge, ranks, steps

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int = 2, coarse: int = 0) -> Logistic:
        a = x.astype(float) if self.ranks else np.c_[x, np.ones(len(x))]
        cost = np.full(a.shape[1], self.ridge)
        if not self.ranks:
            cost[-1] = 1e-9
        w = np.zeros(a.shape[1])
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(cost), a.T @ (p - y) + cost * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def state(self) -> dict:
        return {"w": self.w, "ranks": self.ranks}

    @classmethod
    def of(cls, w: np.ndarray, ranks: bool) -> Logistic:
        made = cls(ranks=ranks)
        made.w = w
        return made

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w if self.ranks else np.c_[x, np.ones(len(x))] @ self.w
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.stack([1 - p, p], 1)


def ranker(x: np.ndarray, y: np.ndarray, problems: np.ndarray, *, pairs: int = 16, ridge: float = 1.0, seed: int = 42) -> Logistic:
    """A linear score that ranks the right traces of each problem over its wrong ones: the logistic loss of differences of
    ``pairs`` pairs a problem, the shorter side repeated."""
    rng = np.random.default_rng(seed)
    differences = []
    order = np.argsort(problems, kind="stable")
    for part in np.split(order, np.flatnonzero(problems[order][1:] != problems[order][:-1]) + 1):
        pos, neg = part[y[part] == 1], part[y[part] == 0]
        if len(pos) and len(neg):
            a, b = (rng.permutation(np.tile(s, pairs // len(s) + 1))[:pairs] for s in (pos, neg))
            differences.append(x[a] - x[b])
    d = np.concatenate(differences) if differences else np.zeros((1, x.shape[1]))
    return Logistic(ridge=ridge, ranks=True).fit(np.concatenate([d, -d]), np.repeat([1, 0], len(d)))


def _factorized(texts: list[list[str]] | pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, code, words): of every word of every text, in order, what text it is of and which of the different words it is."""
    if isinstance(texts, pa.ListArray):
        text = np.repeat(np.arange(len(texts)), texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        words = texts.flatten().dictionary_encode()
        return text, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code, words = pd.factorize(np.fromiter(itertools.chain.from_iterable(texts), dtype=object, count=len(text)), use_na_sentinel=False)
    return text, code, list(words)


class Words:
    """Term weights of texts, as ``tfidf`` gives them: (1 + ln tf)(ln((1 + n)/(1 + df)) + 1), each text scaled to length one,
    over the ``size`` most frequent words of the texts it was fitted to."""

    def __init__(self, texts: list[list[str]] | pa.ListArray, size: int = 8000):
        text, code, words = _factorized(texts)
        total = np.bincount(code, minlength=len(words))
        pair = np.sort(text * max(len(words), 1) + code)  # np.unique would take ten times as long
        df = np.bincount(pair[np.r_[True, pair[1:] != pair[:-1]][: len(pair)]] % max(len(words), 1), minlength=len(words))
        kept = sorted(range(len(words)), key=lambda i: (-total[i], words[i]))[:size]
        self.place = {words[i]: j for j, i in enumerate(kept)}
        self.idf = np.array([np.log((1 + len(texts)) / (1 + df[i])) + 1 for i in kept])

    @classmethod
    def counted(cls, words: list[str], total: np.ndarray, df: np.ndarray, n: int, size: int = 8000) -> Words:
        """Of ``n`` texts: each word's number of places and of texts."""
        made = cls.__new__(cls)
        least = np.partition(total, -size)[-size] if len(total) > size else 0
        kept = sorted(np.flatnonzero(total >= least).tolist(), key=lambda i: (-total[i], words[i]))[:size]
        made.place = {words[i]: j for j, i in enumerate(kept)}
        made.idf = np.log((1 + n) / (1 + df[kept])) + 1
        return made

    def state(self) -> tuple[dict[str, int], np.ndarray]:
        return self.place, self.idf

    @classmethod
    def of(cls, place: dict[str, int], idf: np.ndarray) -> Words:
        made = cls.__new__(cls)
        made.place, made.idf = place, idf
        return made

    def entries(self, texts: list[list[str]] | pa.ListArray) -> Sparse:
        wide = max(len(self.place), 1)
        text, code, words = _factorized(texts)
        place = np.array([self.place.get(w, -1) for w in words], dtype=np.int64)[code]
        at, n = np.unique((text * wide + place)[place >= 0], return_counts=True)
        row, col = at // wide, at % wide
        value = (1 + np.log(n)) * self.idf[col]
        length = np.sqrt(np.bincount(row, value**2, len(texts)))
        return Sparse(row, col, (value / length[row]).astype(np.float32), (len(texts), len(self.place)))

    def weights(self, texts: list[list[str]] | pa.ListArray) -> np.ndarray:
        x = self.entries(texts)
        out = np.zeros(x.shape, dtype=np.float32)
        out[x.row, x.col] = x.value
        return out


class Gathered:
    """Rows that are taken up block by block, held by what isn't zero in as few bytes as it takes: texts as the numbers of their
    words and how often each occurs, which become weights once all texts are known."""

    def __init__(self, words: bool = False, above: bool = True):
        """``above``: only what is greater than zero counts, as trees take it."""
        self.n, self.wide, self.words, self.above, self.parts, self.number = 0, 0, words, above, [], {}

    def add(self, x: np.ndarray, texts: pa.ListArray | None = None) -> None:
        row, col = np.nonzero(x > 0 if self.above else x)
        said = ()
        if self.words:
            text, code, words = _factorized(texts)
            at, times = np.unique(text * max(len(words), 1) + code, return_counts=True)
            number = np.array([self.number.setdefault(w, len(self.number)) for w in words], dtype=np.int32)
            said = ((at // max(len(words), 1)).astype(np.int32), number[at % max(len(words), 1)], np.minimum(times, 65535).astype(np.uint16) if times.max(initial=0) < 65536 else times)
        self.parts.append((len(x), row.astype(np.int32), col.astype(np.uint16 if x.shape[1] < 1 << 16 else np.int64), x[row, col].astype(np.float32), said))
        self.n, self.wide = self.n + len(x), x.shape[1]

    def done(self) -> tuple[Sparse, Words | None]:
        """All rows in order, words before the other features; can be called once."""
        words, known = None, 0
        if self.words:
            total, df = np.zeros((2, len(self.number)), dtype=np.int64)
            for *_, (_, number, times) in self.parts:
                total += np.bincount(number, times, len(total)).astype(np.int64)
                df += np.bincount(number, minlength=len(df))
            names = list(self.number)
            words = Words.counted(names, total, df, self.n)
            known = len(words.place)
            place = np.array([words.place.get(w, -1) for w in names], dtype=np.int64)
            self.number = {}
        small = np.uint16 if known + self.wide < 1 << 16 else np.int64
        rows, cols, values, first = [], [], [], 0
        self.parts.reverse()
        while self.parts:
            n, row, col, value, said = self.parts.pop()
            if said:
                text, at, times = said[0], place[said[1]], said[2]
                kept = at >= 0
                text, at = text[kept], at[kept]
                weight = (1 + np.log(times[kept].astype(float))) * words.idf[at]
                weight = (weight / np.sqrt(np.bincount(text, weight**2, n))[text]).astype(np.float32)
                row, col, value = np.r_[text, row], np.r_[at, col.astype(np.int64) + known], np.r_[weight, value]
                order = np.argsort(row, kind="stable")
                row, col, value = row[order], col[order], value[order]
            rows.append(row + np.int32(first))
            cols.append(col.astype(small))
            values.append(value)
            first += n
        each = []
        for parts, kind in ((rows, np.int32), (cols, small), (values, np.float32)):
            each.append(np.concatenate(parts) if parts else np.zeros(0, dtype=kind))
            parts.clear()
        return Sparse(*each, (self.n, known + self.wide)), words
