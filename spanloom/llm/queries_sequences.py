"""Queries of terms, runs and frequent patterns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.patterns import event_sequences, frequent_patterns
from spanloom.llm.runs import collapse_runs, sequence_events
from spanloom.llm.terms import corpus_terms
from spanloom.plans.tables import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return corpus_terms(table(spark, d, "final_dataset"), table(spark, d, "spans_clustered"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return collapse_runs(sequence_events(table(spark, d, "final_dataset"), table(spark, d, "cluster_names")), min_count=least)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select("trace_id", "start_idx", "end_idx")


def p5_events(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 1)


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return frequent_patterns(event_sequences(table(spark, d, "final_dataset"), table(spark, d, "cluster_names")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d).select("model", "pattern")


def p6_support(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d)


QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p5_found, p5_events, p6_found, p6_support)}

_TERMS = r"""
WITH g AS (
  SELECT trace_id, span_idx, min(trim(regexp_replace(replace(replace(lower(ngram), '‘', ''''), '’', ''''), '[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')) AS term
  FROM spans_clustered WHERE ngram IS NOT NULL GROUP BY ALL),
w0 AS (SELECT trace_id, max(reasoning) AS t FROM final_dataset GROUP BY trace_id),
w AS (
  SELECT trace_id, unnest(regexp_extract_all(replace(replace(lower(t), '‘', ''''), '’', ''''), '''*[a-z][a-z'']*')) AS term FROM w0),
r AS (SELECT 'ngram' AS field, term, trace_id, count(*) AS n FROM g WHERE term <> '' GROUP BY ALL
      UNION ALL SELECT 'reasoning', term, trace_id, count(*) FROM w GROUP BY ALL),
tot AS (SELECT field, count(DISTINCT trace_id) AS total FROM r GROUP BY field),
c AS (SELECT field, term, sum(n)::BIGINT AS occurrences, count(*) AS records FROM r GROUP BY ALL),
m AS (SELECT field, term, occurrences, records, CASE WHEN records < 3 THEN 'rare'
        WHEN records > total * CASE field WHEN 'ngram' THEN 0.10::DOUBLE ELSE 0.40::DOUBLE END THEN 'common' END AS mark
      FROM c JOIN tot USING (field))
"""

_OPS = r"""
WITH nm AS (SELECT cluster, regexp_replace(lower(name), '[^\p{L}]', '', 'g') AS k FROM cluster_names),
cn AS (SELECT a.cluster, min(b.cluster) AS op FROM nm a JOIN nm b ON a.k = b.k AND a.k <> '' GROUP BY a.cluster),
f AS (SELECT trace_id, max(model) AS model, max(operator_sequence) AS s, max(span_start_ms) AS st, max(trace_end_ms) AS te FROM final_dataset GROUP BY trace_id),
e AS (SELECT trace_id, model, te, i - 1 AS pos, coalesce(cn.op, s[i]) AS op, st[i] AS start_ms
      FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM f) x LEFT JOIN cn ON cn.cluster = x.s[i] WHERE s[i] <> -1)
"""

_RUNS = _OPS + r""",
o AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(op) OVER w <> op, true) AS new FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY pos)),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY trace_id ORDER BY pos) AS island FROM o),
u AS (SELECT trace_id, island, any_value(op) AS op, min(pos)::INT AS start_idx, max(pos)::INT AS end_idx, count(*) AS n,
        arg_min(start_ms, pos) AS s0, any_value(te) AS te FROM i GROUP BY trace_id, island),
z AS (SELECT trace_id, op, start_idx, end_idx, n, coalesce(lead(s0) OVER (PARTITION BY trace_id ORDER BY island), te) - s0 AS duration_ms FROM u)
"""

_PATTERNS = _OPS + r""",
q AS (SELECT trace_id, model, op, row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS p FROM e),
l1 AS (SELECT DISTINCT trace_id, model, op::VARCHAR AS pattern, p FROM q),
l2 AS (SELECT DISTINCT a.trace_id, a.model, pattern || '>' || op AS pattern, q.p FROM l1 a JOIN q ON a.trace_id = q.trace_id AND q.p BETWEEN a.p + 1 AND a.p + 3),
l3 AS (SELECT DISTINCT a.trace_id, a.model, pattern || '>' || op AS pattern, q.p FROM l2 a JOIN q ON a.trace_id = q.trace_id AND q.p BETWEEN a.p + 1 AND a.p + 3),
l4 AS (SELECT DISTINCT a.trace_id, a.model, pattern || '>' || op AS pattern, q.p FROM l3 a JOIN q ON a.trace_id = q.trace_id AND q.p BETWEEN a.p + 1 AND a.p + 3),
l5 AS (SELECT DISTINCT a.trace_id, a.model, pattern || '>' || op AS pattern, q.p FROM l4 a JOIN q ON a.trace_id = q.trace_id AND q.p BETWEEN a.p + 1 AND a.p + 3),
c AS (SELECT model, pattern, count(DISTINCT trace_id) AS support FROM (SELECT trace_id, model, pattern FROM l4 UNION ALL SELECT trace_id, model, pattern FROM l5) GROUP BY ALL),
t AS (SELECT model, count(DISTINCT trace_id) AS total FROM e GROUP BY model),
z AS (SELECT c.model, pattern, support, total FROM c JOIN t ON c.model = t.model WHERE support >= 5 AND support >= total * 0.20::DOUBLE)
"""

SQL = {
    "p3_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": _TERMS + "SELECT field, term, occurrences, records, mark FROM m",
    "p5_found": _RUNS + "SELECT trace_id, start_idx, end_idx FROM z WHERE n >= 2",
    "p5_events": _RUNS + "SELECT trace_id, op, start_idx, end_idx, n, duration_ms FROM z",
    "p6_found": _PATTERNS + "SELECT model, pattern FROM z",
    "p6_support": _PATTERNS + "SELECT model, pattern, support, total FROM z",
}
