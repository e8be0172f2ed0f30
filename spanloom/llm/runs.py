"""Runs of one repeated event, collapsed into one event with its count and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.dims import canonical_ids, one_per_key


def sequence_events(traces: DataFrame, names: DataFrame | None, *, skip: int = -1) -> DataFrame:
    """(trace_id, pos, op, start_ms, last): one row per counted entry of each trace and a closing row.

    Entries equal to ``skip`` or null are left out. The closing row has a null op, the position after the last entry,
    and the trace's end as its start; ``last`` tells it apart. Traces whose sequence is null or empty give only that row.
    """
    one = one_per_key(traces, "trace_id", "operator_sequence", "span_start_ms", "trace_end_ms")
    seq = F.coalesce(F.col("operator_sequence"), F.array().cast("array<int>"))
    entries = F.transform(
        seq, lambda x, i: F.struct(i.alias("pos"), x.cast("int").alias("cluster"), F.get(F.col("span_start_ms"), i).alias("start_ms"), F.lit(False).alias("last"))
    )
    counted = F.filter(entries, lambda e: e["cluster"].isNotNull() & (e["cluster"] != skip))
    closing = F.array(F.struct(F.size(seq).alias("pos"), F.lit(None).cast("int").alias("cluster"), F.col("trace_end_ms").alias("start_ms"), F.lit(True).alias("last")))
    events = one.select("trace_id", F.explode(F.concat(counted, closing)).alias("e")).select("trace_id", "e.*")
    if names is None:
        return events.withColumnRenamed("cluster", "op")
    return (
        events.join(canonical_ids(names), "cluster", "left")
        .withColumn("op", F.coalesce("op", "cluster"))
        .select("trace_id", "pos", "op", "start_ms", "last")
    )


def collapse_runs(events: DataFrame, *, min_count: int = 1) -> DataFrame:
    """(trace_id, op, start_idx, end_idx, n, duration_ms) of each run of equal consecutive events.

    Only rows that differ from their predecessor are kept; the next kept row tells where the run ended: the difference
    of the entries' ordinals is its count, the start of the next run (or the end of the trace) less its own start its
    duration. A null start or end time gives a null duration. ``min_count`` leaves out shorter runs.
    """
    order = Window.partitionBy("trace_id").orderBy("pos")
    marked = events.select(
        "*",
        F.row_number().over(order).alias("ord"),
        F.lag("op").over(order).alias("prev_op"),
        F.lag("pos").over(order).alias("prev_pos"),
    )
    starts = marked.where(F.col("last") | F.col("prev_op").isNull() | (F.col("op") != F.col("prev_op")))
    closed = starts.select(
        "*",
        F.lead("ord").over(order).alias("next_ord"),
        F.lead("prev_pos").over(order).alias("end_idx"),
        F.lead("start_ms").over(order).alias("next_ms"),
    )
    return closed.where(~F.col("last") & (F.col("next_ord") - F.col("ord") >= min_count)).select(
        "trace_id",
        "op",
        F.col("pos").cast("int").alias("start_idx"),
        F.col("end_idx").cast("int").alias("end_idx"),
        (F.col("next_ord") - F.col("ord")).cast("long").alias("n"),
        (F.col("next_ms") - F.col("start_ms")).alias("duration_ms"),
    )
