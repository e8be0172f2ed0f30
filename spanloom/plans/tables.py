"""Reading the tables that queries take, and what many of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.pivots import one_span
from spanloom.operators.traces import latest

# The corpus without these is the labelled one; depths in percent.
DROP_DATASETS = ["bbh", "humaneval", "arc_agi2"]
DEPTHS = [10, 25, 50, 75, 100]
SCORES = ["length_within", "length_cross", "op_cross", "d10", "d25", "d50", "d75", "d100"]


def operators(spark: SparkSession, d: str) -> list[int]:
    """The operators' ids, as the table of their names has them: few, whatever the traces."""
    return sorted(r[0] for r in table(spark, d, "cluster_names").where("cluster >= 0").select("cluster").distinct().limit(10_000).collect())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each trace once, by its last delivery."""
    return latest(table(spark, d, "final_dataset"), "trace_id", *columns)


def spans(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_span(table(spark, d, "spans_clustered"), *columns)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Each trace's scores once, by the greatest row."""
    order = ("correct", *SCORES)
    return latest(table(spark, d, "predictions"), "dataset", "model", "problem_id", "correct", *SCORES, by=order)


#: The same in SQL.
TR = """tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY loaded_at DESC NULLS LAST, correct DESC NULLS LAST) AS rn
  FROM final_dataset) WHERE rn = 1)"""
SP = "sp AS (SELECT trace_id, span_idx, max(model) AS model, max(dataset) AS dataset, max(problem_id) AS problem_id, max(anchor) AS anchor, max(body) AS body, max(ngram) AS ngram, max(cluster) AS cluster FROM spans_clustered GROUP BY trace_id, span_idx)"
PR = (
    "pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY correct DESC NULLS LAST, "
    + ", ".join(f"{s} DESC NULLS LAST" for s in SCORES)
    + ") AS rn FROM predictions) WHERE rn = 1)"
)
EV = """ev AS (SELECT trace_id, model, dataset, problem_id, correct, len(s) AS n, i - 1 AS pos, s[i] AS op FROM (
  SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, list_filter(operator_sequence, lambda x: x IS NOT NULL AND x <> -1) AS s FROM tr)))"""

#: Unicode's white space as inside a character class of SQL's regular expressions.
WS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
