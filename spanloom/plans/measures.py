"""Queries of sequences, profiles, grouped metrics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import metrics as m
from spanloom.operators import profiles as p
from spanloom.operators import sequences as s
from spanloom.operators import vectors as v
from spanloom.plans.tables import DEPTHS, EV, PR, SCORES, SP, TR, operators, predictions, spans, table, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ev(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "model", "dataset", "problem_id", "correct", "operator_sequence")
    return s.entries(t, "model", "dataset", "problem_id", "correct")


def _round(df: DataFrame) -> DataFrame:
    return df.select("trace_id", "feature", F.round("value", 9).alias("value"))


@query(f"WITH {TR}, {EV} SELECT trace_id, 'freq_' || op AS feature, round(count(*) / any_value(n), 9) AS value FROM ev GROUP BY trace_id, op")
def sequence_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.frequencies(_ev(spark, d)))


_Q = "q AS (SELECT trace_id, op, least(3, pos // greatest(1, n // 4)) AS q, n, greatest(1, n // 4) AS w FROM ev)"


@query(f"WITH {TR}, {EV}, {_Q} SELECT trace_id, 'quarter_' || q || '_' || op AS feature, round(count(*) / any_value(CASE WHEN q < 3 THEN w ELSE greatest(n - 3 * w, 1) END), 9) AS value FROM q GROUP BY trace_id, q, op")
def sequence_quarters(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.quarters(_ev(spark, d)))


@query(f"""WITH {TR}, {EV}, g AS (SELECT *, coalesce((lag(op) OVER (PARTITION BY trace_id ORDER BY pos) = op)::INT, 0) AS same FROM ev), c AS (SELECT trace_id, op, any_value(n) AS n, count(*) AS c, sum(same) AS same FROM g GROUP BY trace_id, op),
w AS (SELECT trace_id, sum(-(c / n) * ln(c / n)) AS entropy, max(c / n) AS greatest, count(*)::DOUBLE AS distinct_ops, ln(1 + any_value(n)) AS log_length, CASE WHEN any_value(n) > 1 THEN sum(same) / (any_value(n) - 1) ELSE 0.0 END AS repeats FROM c GROUP BY 1)
SELECT trace_id, unnest(['entropy', 'greatest', 'distinct', 'log_length', 'repeats']) AS feature, unnest([round(entropy, 9), round(greatest, 9), distinct_ops, round(log_length, 9), round(repeats, 9)]) AS value FROM w""")
def sequence_scalars(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.scalars(_ev(spark, d)))


@query(f"WITH {TR}, {EV} SELECT trace_id, 'first_' || op AS feature, 1.0::DOUBLE AS value FROM ev WHERE pos = 0 UNION ALL SELECT trace_id, 'last_' || op, 1.0::DOUBLE FROM ev WHERE pos = n - 1")
def sequence_ends(spark: SparkSession, d: str) -> DataFrame:
    return s.ends(_ev(spark, d))


@query(f"WITH {TR}, {EV}, g AS (SELECT *, lead(op) OVER (PARTITION BY trace_id ORDER BY pos) AS nxt FROM ev) SELECT trace_id, 'bigram_' || op || '_' || nxt AS feature, round(count(*) / (any_value(n) - 1), 9) AS value FROM g WHERE nxt IS NOT NULL GROUP BY trace_id, op, nxt")
def sequence_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.bigrams(_ev(spark, d)))


_RUN = "rr AS (SELECT trace_id, op, pos, n, pos - row_number() OVER (PARTITION BY trace_id, op ORDER BY pos) AS g FROM ev), ru AS (SELECT trace_id, op, g, min(pos) AS start, count(*) AS length, any_value(n) AS n FROM rr GROUP BY trace_id, op, g)"


@query(f"WITH {TR}, {EV}, {_RUN} SELECT trace_id, op, start, length, n FROM ru")
def sequence_runs(spark: SparkSession, d: str) -> DataFrame:
    return s.runs(_ev(spark, d)).select("trace_id", "op", "start", "length", "n")


@query(f"WITH {TR}, {EV}, {_RUN} SELECT trace_id, 'run_' || k || '_' || op AS feature, round(value, 9) AS value FROM (SELECT trace_id, op, unnest(['mean', 'max']) AS k, unnest([avg(length) / any_value(n), max(length) / any_value(n)]) AS value FROM ru GROUP BY trace_id, op)")
def sequence_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.run_lengths(_ev(spark, d)))


_ALL_FEATURES = " UNION ALL ".join(f"SELECT trace_id, feature, value FROM ({SQL[q]})" for q in ("sequence_frequencies", "sequence_quarters", "sequence_scalars", "sequence_ends", "sequence_bigrams", "sequence_run_lengths"))


@query(f"SELECT trace_id, feature, value FROM ({_ALL_FEATURES}) WHERE value > 0")
def sequence_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of each sequence's vector that aren't zero, by name."""
    names = s.feature_names(operators(spark, d))
    vec = s.vectors(s.features(_ev(spark, d)), names)
    return vec.select("trace_id", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("f"), F.col("x"))).alias("z")).select("trace_id", F.col("z.f").alias("feature"), F.round("z.x", 9).alias("value")).where("value > 0")


@query()
def sequence_vectors(spark: SparkSession, d: str) -> DataFrame:
    return s.vectors(s.features(_ev(spark, d)), s.feature_names(operators(spark, d))).select("trace_id", F.transform("x", lambda y: F.round(y, 9)).alias("x"))


@query(f"WITH {TR}, {EV} SELECT trace_id, depth, count(*) AS kept FROM ev, (SELECT unnest([10, 25, 50, 75, 100]) AS depth) WHERE pos < greatest(1, (n * depth + 99) // 100) GROUP BY ALL")
def sequence_depths(spark: SparkSession, d: str) -> DataFrame:
    return s.depths(_ev(spark, d), DEPTHS, "ceil").groupBy("trace_id", "depth").agg(F.count("*").alias("kept"))


@query(f"WITH {TR}, {EV} SELECT trace_id, pos, op, coalesce(lead(pos) OVER (PARTITION BY trace_id, op ORDER BY pos), n) AS next_pos, lag(op) OVER (PARTITION BY trace_id ORDER BY pos) AS prev_op FROM ev")
def next_and_previous(spark: SparkSession, d: str) -> DataFrame:
    return s.previous(s.next_same(_ev(spark, d))).select("trace_id", "pos", "op", "next_pos", "prev_op")


@query(f"""WITH {TR}, {EV}, c AS (SELECT trace_id, model, correct, any_value(n) AS n, count(DISTINCT op) AS ops FROM ev GROUP BY ALL),
r AS (SELECT *, md5('42:' || trace_id) AS h, row_number() OVER (PARTITION BY model, correct ORDER BY md5('42:' || trace_id), trace_id) AS rank FROM c WHERE ops >= 4 AND n BETWEEN 15 AND 80),
m AS (SELECT *, row_number() OVER (ORDER BY h, trace_id) AS k FROM r WHERE rank > 1), t AS (SELECT 12 - count(*) AS missing FROM r WHERE rank = 1)
SELECT trace_id, model, correct, n, ops, rank FROM r WHERE rank = 1 UNION ALL SELECT trace_id, model, correct, n, ops, rank FROM m, t WHERE k <= missing""")
def sample_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return s.trajectories(_ev(spark, d), ["model", "correct"], at_least=12)


@query(f"WITH {TR}, {EV}, g AS (SELECT op, lead(op) OVER (PARTITION BY trace_id ORDER BY pos) AS nxt FROM ev), c AS (SELECT op, nxt, count(*) AS n FROM g WHERE nxt IS NOT NULL GROUP BY ALL) SELECT op, nxt, n, n / sum(n) OVER (PARTITION BY op) AS share FROM c")
def transition_shares(spark: SparkSession, d: str) -> DataFrame:
    return p.transition_shares(_ev(spark, d))


_DENSE = f"{TR}, {EV}, tt AS (SELECT DISTINCT trace_id, model, dataset, correct, n FROM ev), oo AS (SELECT DISTINCT cluster AS op FROM cluster_names WHERE cluster >= 0), cc AS (SELECT trace_id, op, count(*) AS c FROM ev GROUP BY ALL), de AS (SELECT tt.*, oo.op, coalesce(c, 0) / n AS f FROM tt CROSS JOIN oo LEFT JOIN cc ON cc.trace_id = tt.trace_id AND cc.op = oo.op)"
_PROF = f"{_DENSE}, wh AS (SELECT op, avg(f) AS m, stddev_pop(f) AS s FROM de GROUP BY 1), pf AS (SELECT model, op, avg(f) AS mean, (avg(f) - any_value(m)) / greatest(any_value(s), 1e-8) AS z FROM de JOIN wh USING (op) GROUP BY model, op)"


@query(f"WITH {_PROF} SELECT model, op, round(mean, 6) AS mean, round(z, 6) AS z FROM pf")
def operator_profiles(spark: SparkSession, d: str) -> DataFrame:
    return p.operator_profiles(_ev(spark, d), operators(spark, d)).select("model", "op", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"))


@query(f"WITH {_PROF} SELECT model, arg_max(op, z) AS most, arg_min(op, z) AS least FROM (SELECT model, op, round(z, 6) AS z FROM pf ORDER BY model, op) GROUP BY 1")
def extreme_operators(spark: SparkSession, d: str) -> DataFrame:
    return p.extreme_operators(p.operator_profiles(_ev(spark, d), operators(spark, d)).withColumn("z", F.round("z", 6)))


_BEST, _WORST = ["quillon-pro", "marlow-think-70b", "harrow-xl"], ["cobble-mix", "fennel-9b", "brindle-14b"]


@query(f"WITH {_PROF}, g AS (SELECT op, avg(mean) FILTER (model IN ('quillon-pro','marlow-think-70b','harrow-xl')) AS best, avg(mean) FILTER (model IN ('cobble-mix','fennel-9b','brindle-14b')) AS worst FROM pf GROUP BY 1) SELECT op, round(best, 6) AS best, round(worst, 6) AS worst, round(best - worst, 6) AS delta FROM g")
def group_contrast(spark: SparkSession, d: str) -> DataFrame:
    g = p.group_contrast(p.operator_profiles(_ev(spark, d), operators(spark, d)), _BEST, _WORST)
    return g.select("op", *[F.round(c, 6).alias(c) for c in ("best", "worst", "delta")])


@query(f"WITH {_DENSE} SELECT dataset, correct, op, round(avg(f) * 100, 6) AS percent FROM de WHERE correct IS NOT NULL GROUP BY ALL")
def correctness_heatmap(spark: SparkSession, d: str) -> DataFrame:
    h = p.correctness_heatmap(_ev(spark, d).where("correct is not null"), operators(spark, d))
    return h.select("dataset", "correct", "op", F.round("percent", 6).alias("percent"))


# Metrics over scores ----------------------------------------------------------------------------------------------------

_LONG = f"{PR}, lo AS (SELECT trace_id, dataset, model, problem_id, correct, unnest({SCORES}) AS method, unnest([{', '.join(SCORES)}]) AS score FROM pr)"


def _auc_sql(groups: str, source: str, y: str = "correct") -> str:
    return f"""(SELECT {groups}, sum(p * (2 * below + q))::DOUBLE / (2.0::DOUBLE * sum(p) * sum(q)) AS auc, sum(p) AS pos, sum(q) AS neg FROM (
  SELECT {groups}, score, p, q, sum(q) OVER (PARTITION BY {groups} ORDER BY score) - q AS below FROM (
    SELECT {groups}, score, sum({y}) AS p, sum(1 - {y}) AS q FROM {source} WHERE {y} IS NOT NULL AND score IS NOT NULL GROUP BY ALL)) GROUP BY {groups} HAVING sum(p) > 0 AND sum(q) > 0)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return m.scores_long(predictions(spark, d), ["trace_id", "dataset", "model", "problem_id", "correct"], SCORES)


@query(f"WITH {_LONG}, a AS {_auc_sql('method, problem_id', 'lo')} SELECT method, problem_id, round(auc, 9) AS auc FROM a")
def problem_auc(spark: SparkSession, d: str) -> DataFrame:
    a = m.auc(_long(spark, d), ["method", "problem_id"], F.col("correct"), F.col("score")).where("auc is not null")
    return a.select("method", "problem_id", F.round("auc", 9).alias("auc"))


@query(f"WITH {_LONG}, a AS {_auc_sql('method, dataset, problem_id', 'lo')} SELECT method, round(avg(auc), 6) AS wp_auc, count(*) AS n_groups FROM a GROUP BY 1")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    w = m.within_auc(_long(spark, d), ["method"], ["dataset", "problem_id"], F.col("correct"), F.col("score"))
    return w.select("method", F.round("wp_auc", 6).alias("wp_auc"), "n_groups")


@query(f"WITH {_LONG}, a AS {_auc_sql('method, dataset, problem_id', 'lo')} SELECT method, dataset, round(avg(auc), 4) AS wp_auc, count(*) AS n_groups FROM a GROUP BY ALL")
def dataset_scores(spark: SparkSession, d: str) -> DataFrame:
    w = m.within_auc(_long(spark, d), ["method", "dataset"], ["problem_id"], F.col("correct"), F.col("score"))
    return w.select("method", "dataset", F.round("wp_auc", 4).alias("wp_auc"), "n_groups")


@query(f"WITH {TR}, lt AS (SELECT dataset, problem_id, correct::INT AS correct, ln(1 + length(coalesce(nullif(reasoning, ''), nullif(model_response, ''), ''))) AS score FROM tr), a AS {_auc_sql('dataset, problem_id', 'lt')} SELECT round(avg(auc), 6) AS wp_auc, count(*) AS n_groups FROM a")
def length_baseline(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.text import fallback_text, log_length

    t = traces(spark, d, "dataset", "problem_id", "correct", "reasoning", "model_response")
    w = m.within_auc(t, [], ["dataset", "problem_id"], F.col("correct"), log_length(fallback_text(F.col("reasoning"), F.col("model_response"))))
    return w.select(F.round("wp_auc", 6).alias("wp_auc"), "n_groups")


_JUDGED = f"{SP}, ju AS (SELECT cluster AS \"true\", CASE WHEN ('0x' || substr(md5('judge:' || trace_id || ':' || span_idx), 1, 8))::UBIGINT % 4 > 0 THEN cluster ELSE (('0x' || substr(md5(trace_id || ':' || span_idx), 1, 8))::UBIGINT % 10)::INT END AS pred, trace_id, span_idx FROM sp WHERE cluster >= 0)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Clusters beside the labels of a stand-in for a judge, who agrees in three of four spans."""
    x = spans(spark, d, "cluster").where("cluster >= 0")
    agrees = F.pmod(m.md5_int(F.lit("judge"), F.col("trace_id"), F.col("span_idx")), F.lit(4)) > 0
    other = F.pmod(m.md5_int(F.col("trace_id"), F.col("span_idx")), F.lit(10)).cast("int")
    return x.select("trace_id", "span_idx", F.col("cluster").alias("true"), F.when(agrees, F.col("cluster")).otherwise(other).alias("pred"))


@query(f"WITH {_JUDGED} SELECT \"true\", pred, count(*) AS n FROM ju GROUP BY ALL")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return m.confusion(_judged(spark, d), "true", "pred")


@query(f"WITH {_JUDGED}, c AS (SELECT \"true\" AS t, pred, count(*) AS n FROM ju GROUP BY ALL), r AS (SELECT t, sum(n) AS s FROM c GROUP BY 1), la AS (SELECT unnest(range(0, 10))::INT AS l) SELECT a.l AS \"true\", b.l AS pred, coalesce(c.n / r.s, 0.0::DOUBLE) AS share FROM la a CROSS JOIN la b LEFT JOIN r ON r.t = a.l LEFT JOIN c ON c.t = a.l AND c.pred = b.l")
def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.range(10).select(F.col("id").cast("int").alias("label"))
    return m.confusion_shares(m.confusion(_judged(spark, d), "true", "pred"), labels)


@query(f"WITH {_JUDGED}, a AS (SELECT \"true\" AS l, count(*) AS a FROM ju GROUP BY 1), b AS (SELECT pred AS l, count(*) AS b FROM ju GROUP BY 1), e AS (SELECT sum(a * b)::DOUBLE AS ab FROM a JOIN b USING (l)), w AS (SELECT count(*) AS n, count(*) FILTER (\"true\" = pred) AS hit FROM ju) SELECT n, hit / n AS agreement, round((hit / n - ab / (n * n::DOUBLE)) / (1 - ab / (n * n::DOUBLE)), 9) AS kappa FROM w, e")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return m.kappa(m.confusion(_judged(spark, d), "true", "pred")).withColumn("kappa", F.round("kappa", 9))


_TWO_LABELS = f"{_JUDGED}, j2 AS (SELECT *, (('0x' || substr(md5('second:' || trace_id || ':' || span_idx), 1, 8))::UBIGINT % 10)::INT AS second FROM ju)"


@query(f"WITH {_TWO_LABELS} SELECT count(*) AS n, round(avg((\"true\" = pred)::INT), 9) AS accuracy, round(avg((\"true\" = pred OR \"true\" = second)::INT), 9) AS accuracy_at_2 FROM j2")
def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d).withColumn("second", F.pmod(m.md5_int(F.lit("second"), F.col("trace_id"), F.col("span_idx")), F.lit(10)).cast("int"))
    hit = F.col("true") == F.col("pred")
    return j.agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 9).alias("accuracy"), F.round(F.avg((hit | (F.col("true") == F.col("second"))).cast("int")), 9).alias("accuracy_at_2"))


@query(f"WITH {_LONG}, ok AS (SELECT method FROM lo WHERE score IS NOT NULL AND correct IS NOT NULL GROUP BY 1 HAVING count(*) >= 50 AND count(DISTINCT correct) = 2), a AS {_auc_sql('method, dataset, problem_id', 'lo')} SELECT method, round(avg(auc), 6) AS wp_auc, count(*) AS n_groups FROM a WHERE method IN (SELECT method FROM ok) GROUP BY 1")
def valid_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The leaderboard without scores of under 50 valid rows or one class."""
    rows = _long(spark, d)
    valid = rows.where("score is not null and correct is not null").groupBy(F.col("method").alias("_m")).agg(F.count("*").alias("n"), F.count_distinct("correct").alias("k")).where("n >= 50 and k = 2")
    w = m.within_auc(rows.join(F.broadcast(valid), F.col("method") == F.col("_m"), "left_semi"), ["method"], ["dataset", "problem_id"], F.col("correct"), F.col("score"))  # a row for each method
    return w.select("method", F.round("wp_auc", 6).alias("wp_auc"), "n_groups")


@query(f"WITH {_JUDGED}, t AS (SELECT \"true\" AS label, count(*) AS support FROM ju GROUP BY 1), p AS (SELECT pred AS label, count(*) AS chosen FROM ju GROUP BY 1), h AS (SELECT pred AS label, count(*) AS hit FROM ju WHERE \"true\" = pred GROUP BY 1) SELECT label, round(coalesce(hit, 0) / chosen, 9) AS precision, round(coalesce(hit, 0) / support, 9) AS recall, round(2.0::DOUBLE * coalesce(hit, 0) / (chosen + support), 9) AS f1, support FROM t JOIN p USING (label) LEFT JOIN h USING (label)")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    c = m.class_scores(m.confusion(_judged(spark, d), "true", "pred"))
    return c.select("label", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")], "support")


@query()
def random_kappa(spark: SparkSession, d: str) -> DataFrame:
    return m.random_kappa(_judged(spark, d), "true", 10, 1000).select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "trials")


@query(f"""WITH {_JUDGED}, c AS (SELECT "true" AS t, pred, count(*) AS n FROM ju GROUP BY ALL), r AS (SELECT t, sum(n) AS s FROM c GROUP BY 1) SELECT t AS "true", pred, CASE WHEN n / s < 0.005 THEN '' ELSE regexp_replace(printf('%.2f', n / s), '^0', '') END AS cell FROM c JOIN r USING (t)""")
def heatmap_cells(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.text import cell

    shares = m.confusion_shares(m.confusion(_judged(spark, d), "true", "pred"), spark.range(10).select(F.col("id").cast("int").alias("label")))
    return shares.where("share > 0").select("true", "pred", cell(F.col("share")).alias("cell"))


_PROBS = f"{_PROF}, mo AS (SELECT DISTINCT model FROM tr), pb AS (SELECT t.trace_id, t.model, mo.model AS cls, (('0x' || substr(md5(t.trace_id || ':' || mo.model), 1, 8))::UBIGINT % 1000 + CASE WHEN t.model = mo.model THEN 400 ELSE 0 END)::DOUBLE AS score, (t.model = mo.model)::INT AS y FROM tr t, mo)"


def _probs(spark: SparkSession, d: str) -> DataFrame:
    """Every trace with a stand-in for a classifier's share of each model."""
    t = traces(spark, d, "model")
    models = t.agg(F.collect_set("model")).scalar()
    each = t.select("trace_id", "model", F.explode(models).alias("cls"))
    score = F.pmod(m.md5_int(F.col("trace_id"), F.col("cls")), F.lit(1000)) + F.when(F.col("model") == F.col("cls"), 400).otherwise(0)
    return each.withColumn("score", score.cast("double"))


@query(f"WITH {_PROBS}, a AS {_auc_sql('cls', 'pb', 'y')} SELECT cls, round(auc, 9) AS auc FROM a")
def one_vs_rest_auc(spark: SparkSession, d: str) -> DataFrame:
    return m.one_vs_rest(_probs(spark, d), "model", "cls", "score").select("cls", F.round("auc", 9).alias("auc"))


@query(f"WITH {_PROBS}, fm AS (SELECT model, split_part(model, '-', 1) AS family FROM mo), fs AS (SELECT trace_id, fm.family AS cls, sum(score) AS score, max((split_part(pb.model, '-', 1) = fm.family)::INT) AS y FROM pb JOIN fm ON fm.model = pb.cls GROUP BY ALL), a AS {_auc_sql('cls', 'fs', 'y')} SELECT cls, round(auc, 9) AS auc FROM a")
def family_auc(spark: SparkSession, d: str) -> DataFrame:
    f = F.split("cls", "-")[0]
    x = _probs(spark, d).groupBy("trace_id", F.split("model", "-")[0].alias("own"), f.alias("family")).agg(F.sum("score").alias("score"))
    return m.one_vs_rest(x, "own", "family", "score").select(F.col("family").alias("cls"), F.round("auc", 9).alias("auc"))


@query(f"""WITH {_LONG}, a AS {_auc_sql('method, dataset, problem_id', 'lo')}, g AS (SELECT dataset || ':' || problem_id AS k, auc FROM a WHERE method = 'op_cross'), r AS (SELECT auc, row_number() OVER (ORDER BY md5(k), k) - 1 AS rank FROM g), n AS (SELECT count(*) AS n FROM r),
dr AS (SELECT b, ('0x' || substr(md5(b || ':' || rank), 1, 8))::UBIGINT % n AS pick FROM r, n, (SELECT unnest(range(0, 2000)) AS b)), me AS (SELECT b, avg(r.auc) AS m FROM dr JOIN r ON r.rank = dr.pick GROUP BY 1)
SELECT round((SELECT avg(auc) FROM r), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM me""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    a = m.auc(_long(spark, d).where("method = 'op_cross'"), ["dataset", "problem_id"], F.col("correct"), F.col("score")).where("auc is not null")
    b = m.bootstrap(a.select(F.concat_ws(":", "dataset", "problem_id").alias("k"), "auc"), "auc", "k", 2000)
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"WITH {PR}, z AS (SELECT 1 AS g, correct AS y, d100 AS score FROM pr), a AS {_auc_sql('g', 'z', 'y')} SELECT round(2 * auc - 1, 9) AS r FROM a")
def rank_biserial(spark: SparkSession, d: str) -> DataFrame:
    return m.rank_biserial(predictions(spark, d), F.col("correct") == 1, F.col("d100")).select(F.round("r", 9).alias("r"))


# Vectors ----------------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


_CEN = "ce AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY ALL)"


@query(f"WITH {_CEN} SELECT label, (i - 1)::INT AS i, round(m, 9) AS value FROM ce")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return v.centroids(_emb(spark, d), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "value")).withColumn("value", F.round("value", 9))


@query(f"WITH {_CEN}, x AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings), di AS (SELECT x.label, vec_id, sqrt(sum((e - m) ** 2)) AS distance FROM x JOIN ce USING (label, i) GROUP BY ALL) SELECT label, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM di) WHERE rank <= 30")
def nearest_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return v.nearest(e, v.centroids(e, "label", "embedding"), "label", "embedding", "vec_id", 30).withColumn("distance", F.round("distance", 6))


_MEMBERS = "me AS (SELECT label, s, list(c ORDER BY i) AS v FROM (SELECT label, vec_id % 5 AS s, i, avg(e) AS c FROM (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY ALL) GROUP BY ALL)"
_COS = f"{_DOT.format(a='a.v', b='b.v')} / (sqrt({_DOT.format(a='a.v', b='a.v')}) * sqrt({_DOT.format(a='b.v', b='b.v')}))"


@query(f"WITH {_MEMBERS} SELECT a.label, a.s AS a, b.s AS b, round({_COS}, 6) AS cosine FROM me a JOIN me b ON a.label = b.label AND a.s < b.s")
def within_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("cosine", F.round("cosine", 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d).withColumn("part", F.col("vec_id") % 5)
    c = v.centroids(e.withColumn("g", F.struct("label", "part")), "g", "embedding").select("g.label", "g.part", "centroid")
    return v.group_pairs(c, "label", "part", "centroid")


@query(f"WITH {_MEMBERS} SELECT a.label, round(median({_COS}), 6) AS median FROM me a JOIN me b ON a.label = b.label AND a.s < b.s GROUP BY 1")
def median_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("label").agg(F.round(F.median("cosine"), 6).alias("median"))


@query(f"WITH z AS (SELECT vec_id AS k, label AS g, embedding AS v, md5('42:' || vec_id) AS h FROM embeddings ORDER BY h, vec_id LIMIT 4000), n AS (SELECT *, coalesce(lag(g) OVER (ORDER BY h, k) <> g, true) AS new FROM z), q AS (SELECT *, sum(new::INT) OVER (ORDER BY h, k) AS r FROM n), p AS (SELECT a.*, b.k AS k2, b.g AS g2, round({_COS}, 6) AS cosine FROM q a JOIN q b ON b.r = a.r + 1 AND b.new) SELECT k, k2, g, g2, cosine FROM p ORDER BY h, k LIMIT 2000")
def across_pairs(spark: SparkSession, d: str) -> DataFrame:
    return v.hashed_pairs(_emb(spark, d), "vec_id", "label", "embedding", 2000).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {PR}, z AS (SELECT d100 AS v FROM pr WHERE d100 IS NOT NULL), w AS (SELECT stddev_samp(v) * 0.15::DOUBLE AS w FROM z) SELECT x, round(avg(exp(-(((x - v) / w) ** 2) / 2) / (w * 2.5066282746310002::DOUBLE)), 6) AS density FROM z, w, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS x) GROUP BY 1")
def score_density(spark: SparkSession, d: str) -> DataFrame:
    return v.density(predictions(spark, d), "d100", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("density", F.round("density", 6))


@query("WITH c AS (SELECT finish_reason AS class, count(*) AS n FROM final_dataset WHERE finish_reason IS NOT NULL GROUP BY 1) SELECT class, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM c")
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    return p.class_shares(table(spark, d, "final_dataset"), "finish_reason").withColumn("percent", F.round("percent", 6))


@query(f"WITH {_JUDGED}, c AS (SELECT \"true\", pred, count(*) AS n FROM ju GROUP BY ALL) SELECT \"true\", pred, n, share, rank FROM (SELECT *, n / sum(n) OVER (PARTITION BY \"true\") AS share, row_number() OVER (PARTITION BY \"true\" ORDER BY n DESC, pred) AS rank FROM c) WHERE rank <= 2")
def relation_alignment(spark: SparkSession, d: str) -> DataFrame:
    return p.alignment(m.confusion(_judged(spark, d), "true", "pred"))


@query(f"WITH {_JUDGED}, j2 AS (SELECT ju.*, sp.model FROM ju JOIN sp USING (trace_id, span_idx)), a AS (SELECT model, \"true\" AS l, count(*) AS a FROM j2 GROUP BY ALL), b AS (SELECT model, pred AS l, count(*) AS b FROM j2 GROUP BY ALL), e AS (SELECT model, sum(a * b)::DOUBLE AS ab FROM a JOIN b USING (model, l) GROUP BY 1), w AS (SELECT model, count(*) AS n, count(*) FILTER (\"true\" = pred) AS hit FROM j2 GROUP BY 1) SELECT model, n, hit / n AS agreement, round((hit / n - ab / (n * n::DOUBLE)) / (1 - ab / (n * n::DOUBLE)), 9) AS kappa FROM w JOIN e USING (model)")
def kappa_by_model(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d).join(spans(spark, d, "model"), ["trace_id", "span_idx"])
    counts = j.groupBy("model", "true", "pred").agg(F.count("*").alias("n"))
    return m.kappa(counts, ["model"]).withColumn("kappa", F.round("kappa", 9))


@query(f"WITH {_LONG}, a AS {_auc_sql('method, dataset, problem_id', 'lo')}, s AS (SELECT method, dataset, round(avg(auc), 4) AS score FROM a GROUP BY ALL) SELECT dataset, min(method) AS best, any_value(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY dataset) AS top FROM s) WHERE score = top GROUP BY 1")
def best_method(spark: SparkSession, d: str) -> DataFrame:
    return p.best_by(dataset_scores(spark, d), "dataset", "method", "wp_auc")


@query(f"WITH {_MEMBERS}, w AS (SELECT 'within' AS kind, round({_COS}, 6) AS c FROM me a JOIN me b ON a.label = b.label AND a.s < b.s), x AS (SELECT 'across' AS kind, round({_COS}, 6) AS c FROM me a JOIN me b ON a.label < b.label AND a.s = b.s) SELECT kind, count(*) AS n, round(median(c), 6) AS median FROM (SELECT * FROM w UNION ALL SELECT * FROM x) GROUP BY 1")
def pair_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median cosines of pairs within a label and across labels, over the means of five parts of each label: few rows."""
    e = _emb(spark, d).withColumn("part", F.col("vec_id") % 5)
    c = v.centroids(e.withColumn("g", F.struct("label", "part")), "g", "embedding").select("g.label", "g.part", "centroid")
    across = v.group_pairs(c, "part", "label", "centroid").select(F.lit("across").alias("kind"), F.round("cosine", 6).alias("c"))
    both = _pairs(spark, d).select(F.lit("within").alias("kind"), F.round("cosine", 6).alias("c")).unionByName(across)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.median("c"), 6).alias("median"))
