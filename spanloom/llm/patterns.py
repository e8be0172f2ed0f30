"""Ordered event patterns with gaps, by bitmap sequence mining.

The positions of every event of a sequence are the bits of a vector. A pattern's vector has a bit at each position where
an occurrence of the pattern can end; shifting it by one to ``max_gap + 1`` places and intersecting it with an event's
vector extends the pattern by that event. The search goes depth first over batches of sequences at once and counts, per
group, the sequences whose vector isn't zero. Batches only emit patterns that some sequence holds, and their counts add
up exactly, so no candidate table is needed and nothing is pruned that could become frequent elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.dims import canonical_ids, one_per_key

WORD = 64
#: words of position vectors that a batch may hold at most: 256 MB
MOST_WORDS = 1 << 25


def event_sequences(traces: DataFrame, names: DataFrame | None, *, skip: int = -1) -> DataFrame:
    """(trace_id, model, seq): each trace once, its entries without ``skip`` and nulls, as operators; empty ones left out."""
    one = one_per_key(traces, "trace_id", "model", "operator_sequence")
    kept = one.select("trace_id", "model", F.posexplode(F.filter("operator_sequence", lambda x: x.isNotNull() & (x != skip))).alias("pos", "cluster"))
    if names is not None:
        kept = kept.join(canonical_ids(names), "cluster", "left").withColumn("cluster", F.coalesce("op", "cluster"))
    return kept.groupBy("trace_id").agg(F.first("model").alias("model"), F.sort_array(F.collect_list(F.struct("pos", F.col("cluster").alias("op")))).alias("s")).select(
        "trace_id", "model", F.col("s.op").alias("seq")
    )


def _shift(bits: np.ndarray, by: int) -> np.ndarray:
    """Each row's bits moved to ``by`` places later, across words."""
    out = np.zeros_like(bits)
    words, rest = divmod(by, WORD)
    if words < bits.shape[1]:
        part = bits[:, : bits.shape[1] - words]
        out[:, words:] = part << np.uint64(rest)
        if rest and part.shape[1] > 1:
            out[:, words + 1 :] |= part[:, :-1] >> np.uint64(WORD - rest)
    return out


def mine_batch(flat: np.ndarray, lengths: np.ndarray, groups: np.ndarray, n_groups: int, min_len: int, max_len: int, max_gap: int):
    """Yields (pattern, counts by group) of the patterns that at least one of these sequences holds."""
    words = int(-(-int(lengths.max()) // WORD))
    ops, codes = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    row = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(flat)) - np.repeat(starts, lengths)
    at = np.zeros((len(ops), len(lengths), words), dtype=np.uint64)
    np.bitwise_or.at(at, (codes, row, pos // WORD), np.uint64(1) << (pos % WORD).astype(np.uint64))

    def extend(bits: np.ndarray, rows: np.ndarray, pattern: tuple) -> Iterator[tuple[tuple, np.ndarray]]:
        if len(pattern) >= min_len:
            yield pattern, np.bincount(groups[rows], minlength=n_groups)
        if len(pattern) == max_len:
            return
        reach = _shift(bits, 1)
        for k in range(2, max_gap + 2):
            reach |= _shift(bits, k)
        for c, op in enumerate(ops):
            nxt = reach & at[c][rows]
            live = nxt.any(axis=1) if words > 1 else nxt[:, 0] != 0
            if live.any():
                yield from extend(nxt[live], rows[live], (*pattern, int(op)))

    for c, op in enumerate(ops):
        rows = np.flatnonzero(at[c].any(axis=1))
        yield from extend(at[c][rows], rows, (int(op),))


def fitting(part: list[tuple[int, np.ndarray]], most: int = MOST_WORDS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The sequences in pieces whose events' vectors fit together: with many events, fewer sequences at once."""
    words = max(-(-len(s) // WORD) for _, s in part)
    if len(part) == 1 or len(np.unique(np.concatenate([s for _, s in part]))) * len(part) * words <= most:
        yield part
    else:
        half = len(part) // 2
        yield from fitting(part[:half], most)
        yield from fitting(part[half:], most)


def _miner(min_len: int, max_len: int, max_gap: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mined(rows: list[tuple[str | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            names = sorted({m for m, _ in rows}, key=lambda m: (m is not None, m or ""))
            index = {m: i for i, m in enumerate(names)}
            out: tuple[list, list, list] = ([], [], [])
            # sequences of like length share a batch: a long one doesn't widen the vectors of the short ones
            by_words: dict[int, list] = {}
            for m, s in rows:
                by_words.setdefault((len(s) - 1) // WORD, []).append((index[m], s))
            for part in (p for whole in by_words.values() for p in fitting(whole)):
                flat, lengths = np.concatenate([s for _, s in part]), np.array([len(s) for _, s in part])
                for pattern, counts in mine_batch(flat, lengths, np.array([g for g, _ in part]), len(names), min_len, max_len, max_gap):
                    text = ">".join(map(str, pattern))
                    for g in np.flatnonzero(counts):
                        out[0].append(names[g])
                        out[1].append(text)
                        out[2].append(int(counts[g]))
                    if len(out[0]) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["model", "pattern", "n"])
                        out = ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["model", "pattern", "n"])

        held: list[tuple[str | None, np.ndarray]] = []
        for b in batches:
            seqs = b.column(1)
            values, offsets = seqs.values.to_numpy(zero_copy_only=False), seqs.offsets.to_numpy()
            held += [(m, values[offsets[i] : offsets[i + 1]]) for i, m in enumerate(b.column(0).to_pylist()) if offsets[i + 1] > offsets[i]]
            if len(held) >= chunk:
                yield from mined(held)
                held = []
        if held:
            yield from mined(held)

    return run


def frequent_patterns(
    sequences: DataFrame, *, min_len: int = 4, max_len: int = 5, max_gap: int = 2, min_support: int = 5, min_share: float = 0.20, chunk: int = 16_384
) -> DataFrame:
    """(model, pattern, support, total): patterns that at least ``min_support`` sequences and ``min_share`` of a model's hold.

    Steps follow one another with at most ``max_gap`` other entries between. ``chunk`` sequences are mined at once, which
    bounds a task's memory; a model may be spread over any number of tasks. A null model is a model of its own.
    """
    found = sequences.select("model", "seq").mapInArrow(_miner(min_len, max_len, max_gap, chunk), "model string, pattern string, n long")
    support = found.groupBy("model", "pattern").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support)
    total = sequences.groupBy(F.col("model").alias("_m")).agg(F.count("*").alias("total"))
    return (
        support.join(total, F.col("model").eqNullSafe(F.col("_m")))
        .where(F.col("support") >= F.col("total") * F.lit(min_share))
        .select("model", "pattern", "support", "total")
    )
