"""Queries over the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import queries_sequences
from spanloom.llm.langid import document_languages, fit_model, relabelled
from spanloom.llm.leakage import leaked_items, leaks, without_leaks
from spanloom.llm.mixing import mixture, mixture_shares
from spanloom.llm.pairs import pair_defects
from spanloom.llm.segment import corpus_units
from spanloom.llm.truncation import truncated, truncation_rates


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(_t(spark, d, "final_dataset")).select("trace_id", "field")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(_t(spark, d, "final_dataset"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return corpus_units(_t(spark, d, "final_dataset"), _t(spark, d, "spans_clustered"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(_t(spark, d, "final_dataset"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def _languages(spark: SparkSession, d: str, within: bool = False) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    return document_languages(docs, fit_model(docs), within=within)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_leaks(spark, d), _t(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(_t(spark, d, "documents").select("doc_id", "text", "lang", "source"), _leaks(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(_languages(spark, d)).select("doc_id", "seg_no", "lang")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "label", F.explode("segments").alias("s")).select("doc_id", "label", "s.*")


def p9_switches(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, within=True).select("doc_id", "label", F.explode("segments").alias("s")).select("doc_id", "label", "s.*")


QUERIES = queries_sequences.QUERIES | {f.__name__: f for f in (p1_found, p1_rates, p2_found, p4_found, p7_found, p7_matches, p7_items, p7_clean, p8_mixture, p8_shares, p9_found, p9_segments, p9_switches)}

SQL: dict[str, str] = {**queries_sequences.SQL}
