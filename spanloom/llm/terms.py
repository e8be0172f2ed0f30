"""Occurrences and records of every distinct value or term, with marks on the rare and the common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Typographic apostrophes and the straight one they stand for.
CURLY_APOSTROPHES, STRAIGHT = "‘’", "''"


def value_term(value: Column) -> Column:
    """The value in lower case, with straight apostrophes and single blanks; null if nothing is left."""
    text = F.translate(F.lower(value), CURLY_APOSTROPHES, STRAIGHT)
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(text) > 0, text)


def word_terms(text: Column) -> Column:
    """Array of the longest runs of a-z and ' in the lower-cased text that hold a letter; empty for null."""
    low = F.translate(F.lower(text), CURLY_APOSTROPHES, STRAIGHT)
    words = F.filter(F.split(low, "[^a-z']+"), lambda w: F.length(F.translate(w, "'", "")) > 0)
    return F.coalesce(words, F.array().cast("array<string>"))


def has_word(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("[a-z]"), F.lit(False))


def value_records(spans: DataFrame) -> DataFrame:
    """(record, term, n) from the ngram of each (trace_id, span_idx), counted once however often it is delivered."""
    one = (
        spans.select("trace_id", "span_idx", value_term(F.col("ngram")).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("trace_id", "span_idx")
        .agg(F.min("term").alias("term"))
    )
    return one.groupBy(F.col("trace_id").alias("record"), "term").agg(F.count("*").alias("n"))


def word_records(traces: DataFrame, text: str = "reasoning") -> DataFrame:
    """(record, term, n) from the words of each trace's text.

    One shuffle by trace_id removes repeated deliveries; the count by (record, term) keeps that partitioning.
    """
    one = traces.select("trace_id", text).where(has_word(F.col(text))).groupBy(F.col("trace_id").alias("record")).agg(F.max(text).alias("t"))
    return one.select("record", F.explode(word_terms(F.col("t"))).alias("term")).groupBy("record", "term").agg(F.count("*").alias("n"))


def term_frequency(records: DataFrame, total: DataFrame, *, rare_below: int, common_above: float) -> DataFrame:
    """(term, occurrences, records, mark) from per-record counts; ``total`` is one row (total): records with any term.

    ``rare``: in fewer than ``rare_below`` records; ``common``: in more than ``common_above`` of ``total``; else null.
    Per-record counts are combined by hash in each task before the shuffle by term, so a term that every record holds
    sends one row per task. No record with a term: an empty result.
    """
    counts = records.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))
    mark = F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") > total.scalar() * F.lit(common_above), F.lit("common"))
    return counts.select("term", "occurrences", "records", mark.alias("mark"))


def corpus_terms(
    traces: DataFrame, spans: DataFrame, *, rare_below: int = 3, common_ngram: float = 0.10, common_word: float = 0.40
) -> DataFrame:
    """(field, term, occurrences, records, mark) for the ngrams of spans and the words of reasonings.

    Null and blank values are no terms; a null trace_id is one record of its own. Empty tables give no rows.
    """
    ngram_total = spans.where(value_term(F.col("ngram")).isNotNull()).select("trace_id").distinct().agg(F.count("*").alias("total"))
    word_total = traces.where(has_word(F.col("reasoning"))).select("trace_id").distinct().agg(F.count("*").alias("total"))
    ngrams = term_frequency(value_records(spans), ngram_total, rare_below=rare_below, common_above=common_ngram)
    words = term_frequency(word_records(traces), word_total, rare_below=rare_below, common_above=common_word)
    return ngrams.select(F.lit("ngram").alias("field"), "*").unionByName(words.select(F.lit("reasoning").alias("field"), "*"))
