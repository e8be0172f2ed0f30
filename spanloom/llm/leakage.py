"""Evaluation texts within a corpus, by suffix arrays over shards of it.

Texts become tokens as a reader compares them: without case, accents, punctuation, markup, layout and typographic forms.
Items in scripts that don't part words by blanks are compared by letters and digits, all others by words. A shard keeps
only stretches of tokens that all occur in some item and are long enough for a match; everything else can't be part of
one. Its suffix array is searched for the suffixes of the items, a bounded number at once; all places that share the least
number of tokens form a range of the array, and the places on one diagonal join to the longest verbatim match. Places are
expanded for some items at a time, so that a passage of many items in many documents costs rows, not memory.

The items are shared with all tasks in blocks of at most ``block_chars`` signs, as whole numbers of four bytes a token. More
items than that take more passes, one after another: the driver holds one block, and each pass's matches are written to
the shared folder. Null and empty texts match nothing.
"""

from __future__ import annotations

import html
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.held import held

_INVISIBLE = regex.compile(r"[­​-‏⁠﻿‪-‮]")
_INLINE = regex.compile(r"</?(?:b|i|u|em|strong|span|a|sub|sup|mark|code|font|small|s|wbr)\b[^<>]{0,200}>", regex.I)
_TAG = regex.compile(r"</?[a-zA-Z!][^<>]{0,300}>")
_MARKS = regex.compile(r"[*_`~\\]+")
_ITEM = regex.compile(r"(?:\A|(?<=[.!?:;。？！…]\s{0,3}\n)|(?<=\n\s{0,3}\n))\s*(?:\(?\d{1,3}[.)]|[-•>#|+]+)\s+(?=\S)")
_QUOTE = regex.compile(r"^\s*(?:>\s?)+", regex.M)
_TOKEN = regex.compile(r"[^\W_]+")
_SIGNS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_LETTERS = regex.compile(r"\p{L}")
_BROKEN = regex.compile(r"[-‐‑]\s*\n\s*")
_FOLD = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "’": "'", "‘": "'", "‐": "-", "‑": "-"})


def plain(text: str) -> str:
    """The text without markup, in one typographic form; line breaks are kept."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).casefold().translate(_FOLD)
        text = "".join(c for c in text if not unicodedata.combining(c))
    else:
        text = text.lower()
    return _MARKS.sub("", _ITEM.sub(" ", _QUOTE.sub("", text)))


def word_tokens(text: str, known: dict[str, int] | None = None) -> list[str]:
    """Words and numbers. A word that a line break parts is one where the joined word is ``known`` and a part isn't."""
    if known is None or not _BROKEN.search(text):
        return _TOKEN.findall(text)
    out: list[str] = []
    end = -1
    for m in _TOKEN.finditer(text):
        w = m[0]
        if out and _BROKEN.fullmatch(text, end, m.start()) and (both := out[-1] + w) in known and not (out[-1] in known and w in known):
            out[-1] = both
        else:
            out.append(w)
        end = m.end()
    return out


def sign_tokens(text: str) -> list[str]:
    """Letters and digits, one by one."""
    return [c for c in text if c.isalnum()]


def by_signs(text: str, lang: str | None) -> bool:
    """Whether an item is compared by signs: by its language, or else by most of its letters."""
    if lang:
        return lang.lower()[:2] in ("zh", "ja", "th")
    return 2 * len(_SIGNS.findall(text)) > len(_LETTERS.findall(text))


class Queries:
    """The tokens of items that are compared in one way, as numbers, one after another."""

    def __init__(self, ids: list[int], texts: list[list[str]], least: int):
        self.least = least
        self.code: dict[str, int] = {}
        kept = [(i, t) for i, t in zip(ids, texts) if len(t) >= least]
        self.ids = np.array([i for i, _ in kept], dtype=np.int64)
        self.tokens = np.fromiter((self.code.setdefault(w, len(self.code) + 1) for _, t in kept for w in t), dtype=np.int32)
        self.ends = np.cumsum([len(t) for _, t in kept], dtype=np.int64)

    @classmethod
    def of(cls, ids: np.ndarray, tokens: np.ndarray, ends: np.ndarray, code: dict[str, int], least: int) -> Queries:
        q = cls([], [], least)
        q.ids, q.tokens, q.ends, q.code = ids, tokens, ends, code
        return q

    def heads(self, size: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, offset, first ``least`` tokens) of every suffix long enough to match, of some whole items at a time."""
        item = 0
        while item < len(self.ids):
            start = int(self.ends[item - 1]) if item else 0
            last = max(item + 1, int(np.searchsorted(self.ends, start + size, side="right")))
            ends = self.ends[item:last]
            lengths = np.diff(np.concatenate(([start], ends)))
            n = lengths - self.least + 1
            which = np.repeat(np.arange(item, last), n)
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            windows = np.lib.stride_tricks.sliding_window_view(self.tokens, self.least)
            yield which, offset, windows[np.repeat(ends - lengths, n) + offset]
            item = last


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling the length that is ranked."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - h] = rank[h:] + 1 if h < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        h *= 2
        if fresh[-1] == n - 1 or h >= n:
            return order


def search(tokens: np.ndarray, order: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array whose suffixes begin with each head, by binary search for all heads at once."""
    m = heads.shape[1]
    padded = np.concatenate([tokens, np.full(m, -1, dtype=np.int64)])

    def bound(right: bool) -> np.ndarray:
        low, high = np.zeros(len(heads), dtype=np.int64), np.full(len(heads), len(order), dtype=np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            window = padded[at[:, None] + np.arange(m)]
            differ = window != heads
            where = differ.argmax(1)
            rows = np.arange(len(heads))
            less = window[rows, where] < heads[rows, where]
            below = np.where(differ.any(1), less, right)
            low = np.where(open_ & below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low

    return bound(False), bound(True)


class Shard:
    """Stretches of documents that can hold a match, gathered until they are searched together."""

    def __init__(self, queries: Queries):
        self.queries, self.size = queries, 0
        self.parts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, doc: int, tokens: list[str]) -> None:
        least, code = self.queries.least, self.queries.code
        if len(tokens) < least:
            return
        ids = np.fromiter((code.get(t, 0) for t in tokens), dtype=np.int64, count=len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                self.parts.append(ids[a:b])
                self.docs.append(np.full(b - a, doc, dtype=np.int64))
                self.places.append(np.arange(a, b))
                self.size += int(b - a)

    def matches(self, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(doc, item, tokens matched, offset in the item, place in the document) of the longest match of each pair, from some
        items at a time: those with at most ``most`` places together, or one item."""
        q = self.queries
        if not self.parts or not len(q.ids):
            return
        # a number of its own ends each stretch: no match runs over it
        top = len(q.code) + 1
        tokens = np.concatenate([np.append(p, top + k) for k, p in enumerate(self.parts)])
        docs = np.concatenate([np.append(d, d[-1]) for d in self.docs])
        places = np.concatenate([np.append(p, p[-1] + 1) for p in self.places])
        order = suffix_array(tokens)
        begun = np.unique(tokens[:-1] * (2 * top) + np.minimum(tokens[1:], top))  # two tokens that a place here begins with
        for item, offset, heads in q.heads():
            here = np.isin(heads[:, 0].astype(np.int64) * (2 * top) + heads[:, 1], begun)
            item, offset, heads = item[here], offset[here], heads[here]
            if not len(item):
                continue
            low, high = search(tokens, order, heads)
            n = high - low
            found = n > 0
            item, offset, low, n = item[found], offset[found], low[found], n[found]
            if not len(item):
                continue
            ends = np.append(np.flatnonzero(np.diff(item)) + 1, len(item))  # after the last suffix of each item
            upto = np.cumsum(n)[ends - 1]
            k = at = 0
            while k < len(ends):
                before = int(upto[k - 1]) if k else 0
                j = max(k + 1, int(np.searchsorted(upto, before + most, side="right")))
                part = slice(at, int(ends[j - 1]))
                yield self._longest(order, docs, places, item[part], offset[part], low[part], n[part])
                k, at = j, part.stop

    def _longest(self, order, docs, places, item, offset, low, n):
        q = self.queries
        which = np.repeat(np.arange(len(n)), n)
        at = order[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        item, offset = item[which], offset[which]
        # neighbouring places on one diagonal are one match
        by = np.lexsort((at, at - offset, item))
        at, item, offset = at[by], item[by], offset[by]
        begins = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(item) != 0) | (np.diff(offset) != 1)))
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(at))) + q.least - 1
        d, i, o, p = docs[at[first]], item[first], offset[first], places[at[first]]
        best = np.lexsort((o, p, -length, i, d))
        d, i, o, p, length = d[best], i[best], o[best], p[best], length[best]
        keep = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(i) != 0)))
        return d[keep], q.ids[i[keep]], length[keep], o[keep], p[keep]


def _searcher(shared, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signs = (Queries.of(*parts) for parts in shared.value)
        shards = {"word": Shard(words), "sign": Shard(signs)}

        def flush(unit: str) -> Iterator[pa.RecordBatch]:
            for d, i, n, o, p in shards[unit].matches():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d), pa.array(i), pa.array([unit] * len(d), pa.string()), *(pa.array(x, pa.int32()) for x in (n, o, p))], ["doc_id", "item_id", "unit", "matched", "item_offset", "doc_offset"]
                )
            shards[unit] = Shard(shards[unit].queries)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                low = plain(text)
                shards["word"].add(doc, word_tokens(low, words.code))
                if len(signs.ids) and _SIGNS.search(low):
                    shards["sign"].add(doc, sign_tokens(low))
                for unit, shard in shards.items():
                    if shard.size >= shard_tokens:
                        yield from flush(unit)
        for unit in shards:
            yield from flush(unit)

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str, str | None]]]:
    """The items in blocks of at most ``most`` signs, or one item; a partition of them is at the driver at a time."""
    block: list[tuple[int, str, str | None]] = []
    size = 0
    for row in items.where(F.length("text") > 0).select("item_id", "text", "lang").toLocalIterator():
        if block and size + len(row.text) > most:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text, row.lang))
        size += len(row.text)
    yield block


def _best(found: DataFrame) -> DataFrame:
    """Of each document and item the longest match, the first of equally long ones."""
    best = F.max(F.struct("matched", (-F.col("doc_offset")).alias("d"), (-F.col("item_offset")).alias("i"), "unit")).alias("b")
    one = found.groupBy("doc_id", "item_id").agg(best)
    return one.select("doc_id", "item_id", "b.unit", "b.matched", (-F.col("b.i")).alias("item_offset"), (-F.col("b.d")).alias("doc_offset"))


def leaks(docs: DataFrame, items: DataFrame, *, least_words: int = 12, least_signs: int = 24, block_chars: int = 8_000_000, shard_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, unit, matched, item_offset, doc_offset): every document and item that share a long enough passage.

    ``matched`` is the length of the longest one, in words or, of items compared by signs, in letters and digits; the offsets
    count the same. Items shorter than the least length can't leak by this measure. Repeated items count once.
    """
    spark = docs.sparkSession

    def search_block(block: list[tuple[int, str, str | None]]) -> tuple[DataFrame, object]:
        flat = [(i, plain(t), lang) for i, t, lang in dict.fromkeys(block)]
        signs = {i: by_signs(t, lang) for i, t, lang in flat}
        parts = [[(i, t) for i, t, _ in flat if signs[i] is kind] for kind in (False, True)]
        made = (Queries([i for i, _ in parts[0]], [word_tokens(t) for _, t in parts[0]], least_words), Queries([i for i, _ in parts[1]], [sign_tokens(t) for _, t in parts[1]], least_signs))
        # at most block_chars signs: some 8 bytes for each, vocabulary included
        shared = spark.sparkContext.broadcast(tuple((q.ids, q.tokens, q.ends, q.code, q.least) for q in made))
        got = docs.select("doc_id", "text").mapInArrow(_searcher(shared, shard_tokens), "doc_id long, item_id long, unit string, matched int, item_offset int, doc_offset int")
        return _best(got), shared

    blocks = _blocks(items, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return search_block(first)[0]
    out: DataFrame | None = None
    for block in itertools.chain([first, second], blocks):
        found, shared = search_block(block)
        found = held(found)
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return _best(out)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents, longest) of every item, 0 documents where it didn't leak."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("matched").alias("longest"))
    return items.select("item_id", "suite").join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "longest")


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item, with all their columns. Null ids are kept: they can't be told affected."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
