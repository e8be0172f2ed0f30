"""A linear-chain conditional random field that labels the words of a text with their languages.

A word's score for a language is the sum of weights of its features: the word itself, its affixes, its character n-grams,
its scripts, and the lists of everyday words that hold it, all hashed to ``SLOTS``. A script limits the languages that its words are
scored for; in the others a word is a foreign one, at a fixed cost. The chain moves between the words of a sentence and,
by transitions that are learned, from sentence to sentence; the gradient of the conditional likelihood comes from
forward-backward. Where no language may change within a sentence, the sentence's words share a label, and the chain is
run over sums of their scores: the same posteriors in fewer steps. All of it is numpy over batches of sequences; a word's
score is computed once per task, however often it occurs.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import regex

from spanloom.llm.languages import SCRIPT_LANGUAGES, word_weights

LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "nl", "pt", "ru", "th", "uk", "zh")
SLOTS = 1 << 15
#: costs of a word in a language of another script, below its mean score in those of its own: one in Latin letters, often a name, and any other
LATIN_ABROAD, ABROAD = 1.0, 6.0

_NOT_WORDS = regex.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\$[^$\n]{1,200}\$|\\\[.*?\\\]|\\\(.*?\\\)|https?://\S+|\\[a-z]+|<[^<>\n]{1,200}>|&#?\w{2,8};", regex.S)
_WORDS = regex.compile(r"[a-zA-Z']++(?![^\x00-\x7f])|[\p{Han}\p{Hiragana}\p{Katakana}ー]{1,3}|\p{Thai}{1,5}|[[\p{L}\p{M}'’]--[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]]+", regex.V1)
_ASCII_WORDS = re.compile("[a-z][a-z']*[a-z]")
_SCRIPTS = [
    ("Latin", regex.compile(r"\p{Latin}")), ("Cyrillic", regex.compile(r"\p{Cyrillic}")), ("Arabic", regex.compile(r"\p{Arabic}")), ("Devanagari", regex.compile(r"\p{Devanagari}")),
    ("Hangul", regex.compile(r"\p{Hangul}")), ("Thai", regex.compile(r"\p{Thai}")), ("Kana", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("Han", regex.compile(r"\p{Han}")),
]
_LISTED = word_weights()
_IN_SCRIPT = {name: np.array([lang in langs for lang in LANGUAGES]) for name, langs in SCRIPT_LANGUAGES.items()}
#: stands in a sentence of Han signs for there being no kana
HAN_ONLY = "\ue000"
_HAN, _KANA = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_VARIABLES = frozenset("abcdefghijklmnopqrstuvwxyz")


def words(text: str, start: int, end: int) -> list[tuple[int, str]]:
    """(position, word) of a stretch of the text, without code, formulas and addresses; single Latin letters are variables."""
    piece = text[start:end]
    if any(c in piece for c in "`$\\/<&"):
        piece = _NOT_WORDS.sub(lambda m: " " * len(m[0]), piece)
    return [(start + m.start(), w) for m in _WORDS.finditer(piece) if len(w := _plain(m[0])) > 1 or (w and w not in _VARIABLES)]


def sentence_words(text: str, start: int, end: int) -> list[str]:
    """The words of a sentence as ``words`` gives them, without their places, and ``HAN_ONLY`` where it holds."""
    piece = text[start:end]
    if any(c in piece for c in "`$\\/<&"):
        piece = _NOT_WORDS.sub(" ", piece)
    low = piece.lower()
    if low.isascii():
        return _ASCII_WORDS.findall(low)
    low = unicodedata.normalize("NFC", low.replace("’", "'"))
    found = [w for x in _WORDS.findall(low) if len(w := x.strip("'")) > 1 or (w and w not in _VARIABLES)]
    if found and len(_HAN.findall(low)) > 3 and not _KANA.search(low):
        found.append(HAN_ONLY)
    return found


def _plain(word: str) -> str:
    low = word.lower()
    return low.strip("'") if low.isascii() else unicodedata.normalize("NFC", low.replace("’", "'")).strip("'")


def script(word: str) -> str | None:
    """The script of a word of this project's languages; None of any other."""
    if word.isascii():
        return "Latin"
    return "Han" if word == HAN_ONLY else next((name for name, pattern in _SCRIPTS if pattern.search(word)), None)


def features(word: str) -> list[int]:
    w = word
    edged = f"^{w}$"
    names = [f"w{w}", *(f"p{w[:k]}" for k in (1, 2, 3)), *(f"s{w[-k:]}" for k in (1, 2, 3))]
    names += [f"L{lang}" for lang, _ in _LISTED.get(w, ())]
    if not w.isascii():
        names += [f"S{name}" for name, pattern in _SCRIPTS if pattern.search(w)]
    names += [f"c{c}" for c in w if c > "\x7f"]
    names += [f"n{edged[i : i + k]}" for k in (3, 2) for i in range(len(edged) - k + 1)]
    return [zlib.crc32(n.encode()) % SLOTS for n in dict.fromkeys(names)]


class Features:
    """The feature slots of words one after another, with where each word's begin, and the languages of each word's script."""

    def __init__(self, types: list[str]):
        each = [features(t) for t in types]
        self.size = np.array([len(f) for f in each], dtype=np.int64)
        self.slots = np.fromiter((x for f in each for x in f), dtype=np.int64, count=int(self.size.sum()))
        self.starts = np.cumsum(self.size) - self.size
        scripts = [script(t) for t in types]
        none = np.zeros(len(LANGUAGES), dtype=bool)
        self.home = np.array([_IN_SCRIPT.get(x, none) for x in scripts], dtype=bool).reshape(-1, len(LANGUAGES))
        self.latin = np.array([x == "Latin" for x in scripts], dtype=bool)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, languages): sums of weights, the costs of foreign words, 0 for words of an unknown script."""
        out = np.zeros((len(self.size), weights.shape[1]), dtype=np.float32)
        for i in range(0, len(out), 8192):
            part = slice(i, min(i + 8192, len(out)))
            low = self.starts[part.start]
            high = self.starts[part.stop - 1] + self.size[part.stop - 1]
            out[part] = np.add.reduceat(weights[self.slots[low:high]], self.starts[part] - low)
        mean = np.where(self.home, out, 0).sum(1, keepdims=True) / np.maximum(self.home.sum(1, keepdims=True), 1)
        away = mean - np.where(self.latin, LATIN_ABROAD, ABROAD)[:, None]
        out = np.where(self.home, out, away)
        out[~self.home.any(1)] = 0
        return out.astype(np.float32)


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, inner: np.ndarray | None = None, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (B, T, L) of the label of each place and the expected number of each transition (L, L), summed over sequences.

    ``emit``: (B, T, L) scores; ``mask``: (B, T), true at places, which come first in each row; ``trans``: (L, L) scores.
    ``inner``: those to places where ``begins`` (B, T) is false; such transitions aren't counted.
    """
    n, t, size = emit.shape
    e = np.maximum(np.exp(emit - emit.max(2, keepdims=True)), 1e-30).astype(np.float64)
    move = np.exp(trans.astype(np.float64))
    within = None if inner is None else np.exp(inner.astype(np.float64))
    fwd, bwd = np.empty((n, t, size)), np.ones((n, t, size))
    a = e[:, 0] / size
    fwd[:, 0] = a / a.sum(1, keepdims=True)
    for k in range(1, t):
        a = fwd[:, k - 1] @ move
        if within is not None:
            a = np.where(begins[:, k, None], a, fwd[:, k - 1] @ within)
        a *= e[:, k]
        a /= a.sum(1, keepdims=True)
        fwd[:, k] = np.where(mask[:, k, None], a, fwd[:, k - 1])
    pairs = np.zeros((size, size))
    for k in range(t - 2, -1, -1):
        right = e[:, k + 1] * bwd[:, k + 1]
        b = right @ move.T
        counted = mask[:, k + 1]
        if within is not None:
            b = np.where(begins[:, k + 1, None], b, right @ within.T)
            counted = counted & begins[:, k + 1]
        # the sum over sequences of fwd x move x right, each scaled to one
        total = (fwd[:, k] * (right @ move.T)).sum(1)
        pairs += (fwd[:, k] * (counted / total)[:, None]).T @ right * move
        b /= b.max(1, keepdims=True)
        bwd[:, k] = np.where(mask[:, k + 1, None], b, 1.0)
    post = fwd * bwd
    post /= post.sum(2, keepdims=True)
    return post, pairs


def _batches(lengths: list[int], cells: int = 60_000):
    """Indices of sequences of like length, so that a batch has few padded places."""
    order = [i for i in sorted(range(len(lengths)), key=lengths.__getitem__) if lengths[i]]
    at = 0
    while at < len(order):
        k = at + 1
        while k < len(order) and (k + 1 - at) * lengths[order[k]] <= cells:
            k += 1
        yield order[at:k]
        at = k


def _chains(emit: np.ndarray, lengths: list[int], trans: np.ndarray, inner: np.ndarray | None = None, begins: np.ndarray | None = None):
    """Forward-backward over sequences that lie one after another in ``emit``: posteriors in the same order, and transitions."""
    starts = np.cumsum([0, *lengths])
    post, pairs = np.zeros(emit.shape), np.zeros(trans.shape)
    for part in _batches(lengths):
        widest = lengths[part[-1]]
        size = np.array([lengths[i] for i in part])
        mask = np.arange(widest) < size[:, None]
        at = (starts[part][:, None] + np.arange(widest))[mask]
        grid = np.zeros((len(part), widest, emit.shape[1]), dtype=np.float32)
        grid[mask] = emit[at]
        opens = None
        if begins is not None:
            opens = np.zeros(mask.shape, dtype=bool)
            opens[mask] = begins[at]
        got, moved = forward_backward(grid, mask, trans, inner, opens)
        post[at] = got[mask]
        pairs += moved
    return post, pairs


class Model:
    """Weights of features, transitions between sentences, and per language the words it is known by and how many of a text's
    words those usually are."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, known: np.ndarray | None = None, usual: np.ndarray | None = None):
        self.weights, self.trans = weights, trans
        self.known = np.zeros(0, dtype=np.int64) if known is None else known
        self.usual = np.ones(len(LANGUAGES)) if usual is None else usual
        self.codes: dict[str, int] = {}
        self.table = np.zeros((0, 2 * len(LANGUAGES)), dtype=np.float32)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.weights, self.trans, self.known, self.usual

    def __reduce__(self):
        return Model, self.arrays()

    def rows(self, found: list[str]) -> np.ndarray:
        """(words, 2 x languages): each word's scores, then in which languages it is known."""
        if len(self.codes) > 300_000:
            self.codes, self.table = {}, self.table[:0]
        codes = self.codes
        ids = list(map(codes.get, found))
        if None in ids:
            fresh = list(dict.fromkeys(w for w, i in zip(found, ids) if i is None))
            base = len(codes)
            codes.update((w, base + i) for i, w in enumerate(fresh))
            seen = np.array([_code(w) for w in fresh])[:, None] * len(LANGUAGES) + np.arange(len(LANGUAGES))
            hit = np.isin(seen, self.known)
            self.table = np.concatenate([self.table, np.concatenate([Features(fresh).scores(self.weights), hit], axis=1).astype(np.float32)])
            ids = list(map(codes.get, found))
        return self.table[np.array(ids, dtype=np.int64)]

    def sentences(self, texts: list[list[list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text, of its sentences with words: the probabilities of the languages, and how sure a reader who knows just
        these languages can be of each, by the share of words known: (sentences, languages) both."""
        size = len(LANGUAGES)
        lengths = [len(s) for t in texts for s in t if s]
        counts = [sum(1 for s in t if s) for t in texts]
        if not lengths:
            return [(np.zeros((0, size)), np.zeros((0, size)))] * len(texts)
        rows = self.rows([w for t in texts for s in t for w in s])
        sums = np.add.reduceat(rows, np.cumsum(lengths) - np.array(lengths), axis=0, dtype=np.float32)
        post, _ = _chains(sums[:, :size], counts, self.trans)
        share = np.minimum(1, sums[:, size:] / np.array(lengths)[:, None] / np.maximum(0.6 * self.usual, 1e-3))
        at = np.cumsum([0, *counts])
        return [(post[a:b], share[a:b]) for a, b in zip(at[:-1], at[1:])]

    def words(self, texts: list[list[list[str]]], switch: float = -4.0) -> list[np.ndarray]:
        """Of each text, (words, languages): the probabilities of each word's language, which may change within a sentence,
        at a score of ``switch``."""
        size = len(LANGUAGES)
        lengths = [sum(map(len, t)) for t in texts]
        if not sum(lengths):
            return [np.zeros((0, size))] * len(texts)
        emit = self.rows([w for t in texts for s in t for w in s])[:, :size]
        begins = np.concatenate([np.arange(len(s)) == 0 for t in texts for s in t if s])
        inner = np.full((size, size), switch)
        np.fill_diagonal(inner, 0.0)
        post, _ = _chains(emit, lengths, self.trans, inner, begins)
        at = np.cumsum([0, *lengths])
        return [post[a:b] for a, b in zip(at[:-1], at[1:])]


def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def fit(texts: list[list[list[str]]], labels: list[int], *, first: int = 30, rounds: int = 3, steps: int = 6, l2: float = 1e-3) -> Model:
    """A model from sentences of words of texts and one label each, which may be wrong or hold for a part only.

    First the words alone are fitted to their text's label, but for Latin ones of one text only, which are mostly names. Then, in
    ``rounds``, every sentence takes the label that the model gives it, and the field with its transitions is fitted to
    these: labels that the rest contradicts are corrected, and texts of several languages show where one follows another.
    """
    size = len(LANGUAGES)
    texts = [[s for s in t if s] for t in texts]
    types = list(dict.fromkeys(w for t in texts for s in t for w in s))
    index = {w: i for i, w in enumerate(types)}
    made = Features(types)
    weights = np.zeros((SLOTS, size), dtype=np.float32)
    trans = np.full((size, size), -4.0, dtype=np.float32)
    np.fill_diagonal(trans, 0.0)
    square = np.full(weights.shape, 1e-6, dtype=np.float32)
    flat = [np.array([index[w] for s in t for w in s], dtype=np.int64) for t in texts]
    texts_of = np.zeros((len(types), size))
    held = np.zeros((len(types), size))
    for ids, y in zip(flat, labels):
        np.add.at(held[:, y], ids, 1)
        texts_of[np.unique(ids), y] += 1
    shared = (texts_of.sum(1) >= 2) | ~made.latin

    def climb(gradient: np.ndarray, rate: float) -> None:
        """One Adagrad step from the gradient of the words' scores; foreign words and names teach nothing."""
        gradient = np.where(made.home & shared[:, None], gradient, 0)
        full = np.stack([np.bincount(made.slots, np.repeat(gradient[:, k], made.size), SLOTS) for k in range(size)], 1).astype(np.float32)
        full -= l2 * weights
        square[:] += full**2
        weights[:] += rate * full / np.sqrt(square)

    total = held.sum(1, keepdims=True)
    for _ in range(first):
        e = made.scores(weights)
        p = np.exp(e - e.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        climb(held - total * p, 0.3)

    lengths = np.array([len(s) for t in texts for s in t], dtype=np.int64)
    counts = [len(t) for t in texts]
    every = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    follows = np.ones(len(lengths), dtype=bool)  # whether a sentence follows another of its text
    follows[(np.cumsum(counts) - np.array(counts))[np.array(counts) > 0] if counts else []] = False
    gold = np.zeros(0, dtype=np.int64)
    for _ in range(rounds if len(every) else 0):
        sums = np.add.reduceat(made.scores(weights)[every], starts, axis=0)
        gold = _chains(sums, counts, trans)[0].argmax(1)
        seen = np.full((size, size), 1e-2)
        np.add.at(seen, (gold[:-1][follows[1:]], gold[1:][follows[1:]]), 1)
        for _ in range(steps):
            sums = np.add.reduceat(made.scores(weights)[every], starts, axis=0)
            post, expected = _chains(sums, counts, trans)
            step = -post
            step[np.arange(len(gold)), gold] += 1
            each = np.repeat(step, lengths, axis=0)
            climb(np.stack([np.bincount(every, each[:, k], len(types)) for k in range(size)], 1), 0.1)
            trans += 0.5 * np.clip(np.log(seen + 0.5) - np.log(expected + 0.5), -1, 1).astype(np.float32)
            np.clip(trans, -9, 3, out=trans)
    # a language is known by the words that some texts of it hold; how many of a text's words those are is learned from the texts
    known, usual = texts_of >= 2, np.ones(size)
    if len(every):
        hits = np.add.reduceat(known[every], starts, axis=0, dtype=np.float32) / lengths[:, None]
        for k in range(size):
            own = hits[gold == k, k]
            usual[k] = np.median(own) if len(own) else 1.0
    at, lang = np.nonzero(known)
    codes = np.array([_code(t) for t in types], dtype=np.int64)
    return Model(weights, trans, np.sort(codes[at] * size + lang) if len(at) else None, usual)
