"""Traces as a stream: new files are cut into sentences as they come, and each trace is kept once.

Segmentation needs no state, for a record carries its whole trace; what was delivered before is known from the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.text import opener, sentence_list
from spanloom.sources.jsonl import append_new


def sentence_stream(spark: SparkSession, path: str, schema: str, text: str = "reasoning", files_per_trigger: int = 1000) -> DataFrame:
    """(trace_id, model, dataset, i, sentence, ngram) of every trace that arrives in a folder of JSON lines."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    cut = rows.select("trace_id", "model", "dataset", F.posexplode(sentence_list(F.col(text))).alias("i", "sentence"))
    return cut.withColumn("ngram", opener(F.col("sentence")))


def store_traces(stream: DataFrame, target: str, checkpoint: str, key: str | tuple[str, ...] = "trace_id") -> StreamingQuery:
    """Appends to a folder the rows whose key it doesn't hold, each once; a repeated batch adds nothing. Of sentences the key is
    (trace_id, i)."""

    def step(batch: DataFrame, _: int) -> None:
        append_new(batch, target, key)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, group, n, value): events by window; those later than the watermark are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), group, "n", "value")
