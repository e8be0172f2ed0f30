"""Features of operator sequences, in long form: (trace_id, feature, value).

All windows and groups share the partitioning by trace_id that removing repeated deliveries has made; no more shuffles
follow. Empty sequences have no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(traces: DataFrame, *keep: str, skip: int = -1) -> DataFrame:
    """(trace_id, ..., pos, op, n): one row per entry, numbered from 0 without those skipped."""
    seq = F.filter("operator_sequence", lambda x: x.isNotNull() & (x != skip))
    s = traces.select("trace_id", *keep, seq.alias("_s"))
    return s.select("trace_id", *keep, F.size("_s").alias("n"), F.posexplode("_s").alias("pos", "op"))


def prefix(ev: DataFrame, percent: int, rounding: str = "floor") -> DataFrame:
    """The first ``percent`` of each sequence, one entry at least; ``n`` is the new length."""
    up = 99 if rounding == "ceil" else 0
    keep = F.greatest(F.lit(1), F.expr(f"(n * {percent} + {up}) div 100").cast("int"))
    return ev.withColumn("_k", keep).where(F.col("pos") < F.col("_k")).withColumn("n", F.col("_k")).drop("_k")


def depths(ev: DataFrame, percents: list[int], rounding: str = "floor") -> DataFrame:
    """Every sequence at each of some depths, told apart by ``depth``."""
    return reduce(DataFrame.unionByName, [prefix(ev, p, rounding).withColumn("depth", F.lit(p)) for p in percents])


def _named(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws("_", F.lit(kind), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def frequencies(ev: DataFrame) -> DataFrame:
    return ev.groupBy("trace_id", "op").agg((F.count("*") / F.max("n")).alias("value")).select("trace_id", _named("freq", "op").alias("feature"), "value")


def quarters(ev: DataFrame) -> DataFrame:
    """Shares within quarters of max(1, n div 4) entries; the last takes the rest. Quarters beyond a short sequence are empty."""
    size = F.greatest(F.lit(1), F.expr("n div 4")).cast("int")
    q = F.least(F.lit(3), F.floor(F.col("pos") / size)).cast("int")
    marked = ev.select("trace_id", "op", q.alias("q"), F.when(q < 3, size).otherwise(F.greatest(F.col("n") - 3 * size, F.lit(1))).alias("w"))
    return marked.groupBy("trace_id", "q", "op").agg((F.count("*") / F.max("w")).alias("value")).select("trace_id", _named("quarter", "q", "op").alias("feature"), "value")


def scalars(ev: DataFrame) -> DataFrame:
    """Entropy, greatest share, number of operators, log of the length, share of repeats."""
    order = Window.partitionBy("trace_id").orderBy("pos")
    by = ev.withColumn("same", F.coalesce((F.lag("op").over(order) == F.col("op")).cast("int"), F.lit(0)))
    counts = by.groupBy("trace_id", "op").agg(F.count("*").alias("c"), F.sum("same").alias("same"), F.max("n").alias("n"))
    p = F.col("c") / F.col("n")
    whole = counts.groupBy("trace_id").agg(
        F.sum(-p * F.log(p)).alias("entropy"), F.max(p).alias("greatest"), F.count("*").cast("double").alias("distinct"),
        F.log1p(F.max("n")).alias("log_length"), F.coalesce(F.try_divide(F.sum("same"), F.max("n") - 1), F.lit(0.0)).alias("repeats"),
    )
    return whole.unpivot("trace_id", ["entropy", "greatest", "distinct", "log_length", "repeats"], "feature", "value")


def ends(ev: DataFrame) -> DataFrame:
    one = ev.where((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1))
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("pos") == 0, F.lit("first")), F.when(F.col("pos") == F.col("n") - 1, F.lit("last")))))
    return one.select("trace_id", "op", kinds.alias("k")).select("trace_id", F.concat_ws("_", "k", F.col("op").cast("string")).alias("feature"), F.lit(1.0).alias("value"))


def bigrams(ev: DataFrame) -> DataFrame:
    """Joint shares of neighbouring pairs: of all n - 1, not of each row."""
    order = Window.partitionBy("trace_id").orderBy("pos")
    pairs = ev.withColumn("nxt", F.lead("op").over(order)).where(F.col("nxt").isNotNull())
    return pairs.groupBy("trace_id", "op", "nxt").agg((F.count("*") / (F.max("n") - 1)).alias("value")).select(
        "trace_id", _named("bigram", "op", "nxt").alias("feature"), "value"
    )


def runs(ev: DataFrame) -> DataFrame:
    """(trace_id, op, start, length, n) of the stretches of one operator."""
    order = Window.partitionBy("trace_id").orderBy("pos")
    new = F.coalesce((F.lag("op").over(order) != F.col("op")).cast("int"), F.lit(1))
    marked = ev.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return marked.groupBy("trace_id", "run", "op").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.max("n").alias("n"))


def run_lengths(ev: DataFrame) -> DataFrame:
    """Mean and greatest run of each operator, of the sequence's length."""
    per = runs(ev).groupBy("trace_id", "op").agg((F.avg("length") / F.max("n")).alias("mean"), (F.max("length") / F.max("n")).alias("max"))
    return per.unpivot(["trace_id", "op"], ["mean", "max"], "k", "value").select("trace_id", F.concat_ws("_", F.lit("run"), "k", F.col("op").cast("string")).alias("feature"), "value")


def features(ev: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(ev) for f in (frequencies, quarters, scalars, ends, bigrams, run_lengths)])


def vectors(long: DataFrame, names: list[str]) -> DataFrame:
    """(trace_id, x): the features in the order of ``names``, 0 where a trace has none."""
    per = long.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return per.select("trace_id", F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0))).alias("x"))


def feature_names(ops: list[int]) -> list[str]:
    """Of these operators: shares, quarters, scalars, ends, pairs, runs; 117 for seven."""
    return [
        *(f"freq_{a}" for a in ops), *(f"quarter_{q}_{a}" for q in range(4) for a in ops), "entropy", "greatest", "distinct", "log_length", "repeats",
        *(f"{e}_{a}" for e in ("first", "last") for a in ops), *(f"bigram_{a}_{b}" for a in ops for b in ops), *(f"run_{s}_{a}" for s in ("mean", "max") for a in ops),
    ]


def feature_rows(row: np.ndarray, op: np.ndarray, count: int, ops: list[int]) -> np.ndarray:
    """(count, features): what ``vectors`` of ``features`` gives, of entries in order, each with its sequence's number."""
    kinds, at = np.unique(np.concatenate([np.array(ops, dtype=np.int64), op]), return_inverse=True)
    own, k, op = np.searchsorted(kinds, ops), len(kinds), at[len(ops) :]
    n = np.bincount(row, minlength=count)
    pos = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    per = lambda r, o, width, w=None: np.bincount(r * width + o, w, count * width).reshape(count, width)
    some, more = np.maximum(n, 1)[:, None], np.maximum(n - 1, 1)[:, None]
    freq = per(row, op, k) / some
    size = np.maximum(1, n // 4)
    q = np.minimum(3, pos // size[row])
    quarter = per(row, q * k + op, 4 * k).reshape(count, 4, k) / np.stack([size, size, size, np.maximum(n - 3 * size, 1)], 1)[:, :, None]
    entropy = -(freq * np.log(np.where(freq > 0, freq, 1))).sum(1)
    first, last = pos == 0, pos == n[row] - 1
    follows = np.flatnonzero(row[1:] == row[:-1])
    pairs = per(row[follows], op[follows] * k + op[follows + 1], k * k).reshape(count, k, k)
    repeats = np.trace(pairs, axis1=1, axis2=2) / more[:, 0]
    begin = np.flatnonzero(first | np.r_[True, op[1:] != op[:-1]][: len(op)])
    length = np.diff(np.r_[begin, len(op)])
    runs = per(row[begin], op[begin], k)
    longest = np.zeros(count * k, dtype=np.int64)
    np.maximum.at(longest, row[begin] * k + op[begin], length)
    mean = per(row[begin], op[begin], k, length) / np.maximum(runs, 1) / some
    return np.concatenate([
        freq[:, own], quarter[:, :, own].reshape(count, -1), np.stack([entropy, freq.max(1, initial=0), (freq > 0).sum(1), np.log1p(n), repeats], 1),
        per(row[first], op[first], k)[:, own], per(row[last], op[last], k)[:, own], (pairs / more[:, :, None])[:, own][:, :, own].reshape(count, -1),
        mean[:, own], (longest.reshape(count, k) / some)[:, own],
    ], 1)


def with_features(df: DataFrame, ops: list[int], skip: int = -1) -> DataFrame:
    """Rows with ``x`` instead of ``operator_sequence``: its features in the order of ``feature_names``; rows without an entry drop out."""
    keep = [c for c in df.columns if c != "operator_sequence"]
    kept = df.withColumn("operator_sequence", F.filter("operator_sequence", lambda o: o.isNotNull() & (o != skip))).where(F.size("operator_sequence") > 0)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            s = b.column(b.num_columns - 1)
            row = np.repeat(np.arange(b.num_rows), s.value_lengths().to_numpy(zero_copy_only=False))
            x = feature_rows(row, s.flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.num_rows, ops)
            ends = pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.float32)))], [*keep, "x"])

    types = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return kept.select(*keep, "operator_sequence").mapInArrow(batches, f"{types}, x array<float>")


def next_same(ev: DataFrame) -> DataFrame:
    """``next_pos``: where the same operator comes again; the sequence's length where it doesn't."""
    own = Window.partitionBy("trace_id", "op").orderBy("pos")
    return ev.withColumn("next_pos", F.coalesce(F.lead("pos").over(own), F.col("n")))


def regions(places: DataFrame) -> DataFrame:
    """(trace_id, k, start, stop) from (trace_id, k, op, start, length): of each place that was found, up to the next one of the
    same operator, else to the text's end."""
    own = Window.partitionBy("trace_id", "op").orderBy("k")
    found = places.where(F.col("start").isNotNull())
    return found.select("trace_id", "k", "start", F.coalesce(F.lead("start").over(own), F.col("length")).alias("stop"))


def previous(ev: DataFrame) -> DataFrame:
    order = Window.partitionBy("trace_id").orderBy("pos")
    return ev.withColumn("prev_op", F.lag("op").over(order))


def padded(seq: Column, length: int, pad: int) -> Column:
    """The first ``length`` entries, shorter ones filled up."""
    return F.slice(F.concat(seq, F.array_repeat(F.lit(pad), length)), 1, length)


def trajectories(ev: DataFrame, keep: list[str], *, least_ops: int = 4, shortest: int = 15, longest: int = 80, per_cell: int = 1, at_least: int = 0, seed: str = "42") -> DataFrame:
    """Sample traces of a middling length and several operators, ``per_cell`` of each cell of ``keep``, by hash, then others in
    hash order up to ``at_least``."""
    per = ev.groupBy("trace_id", *keep).agg(F.max("n").alias("n"), F.count_distinct("op").alias("ops"))
    fit = per.where((F.col("ops") >= least_ops) & F.col("n").between(shortest, longest))
    order = Window.partitionBy(*keep).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "trace_id")), "trace_id")
    h = F.md5(F.concat_ws(":", F.lit(seed), "trace_id"))
    ranked = fit.withColumn("rank", F.row_number().over(order))
    first = ranked.where(F.col("rank") <= per_cell)
    missing = F.greatest(F.lit(at_least) - first.agg(F.count("*")).scalar(), F.lit(0))
    more = ranked.where(F.col("rank") > per_cell).orderBy(h, "trace_id").limit(at_least)  # at_least rows
    numbered = more.withColumn("_k", F.row_number().over(Window.orderBy(h, "trace_id"))).where(F.col("_k") <= missing).drop("_k")
    return first.unionByName(numbered)
