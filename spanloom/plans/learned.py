"""Queries of learners, sources and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import alpha_tokens, fallback_text, log_length
from spanloom.operators import folds as fo
from spanloom.operators import learning as ml
from spanloom.operators import metrics as m
from spanloom.operators import sequences as s
from spanloom.operators.held import held
from spanloom.operators.pivots import top_per_group
from spanloom.operators.vectors import char_ngram_vectors
from spanloom.plans.tables import TR, operators, spans, table, traces
from spanloom.sources import jsonl, judge
from spanloom.streaming.traces import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d, "model", "dataset", "problem_id", "correct", "operator_sequence", "reasoning", "model_response").where("correct is not null")


@query(f"""WITH {TR}, tk AS (SELECT trace_id, unnest(regexp_extract_all(lower(reasoning), '[a-z'']+')) AS token FROM tr WHERE reasoning IS NOT NULL), tf AS (SELECT trace_id, token, count(*) AS tf FROM tk GROUP BY ALL),
te AS (SELECT token, sum(tf) AS n, count(*) AS df FROM tf GROUP BY 1 ORDER BY n DESC, token LIMIT 8000), c AS (SELECT count(DISTINCT trace_id) AS n FROM tr WHERE reasoning IS NOT NULL),
w AS (SELECT trace_id, token, (1 + ln(tf)) * (ln((1 + c.n) / (1 + df)) + 1) AS w FROM tf JOIN te USING (token), c) SELECT trace_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY trace_id)), 6) AS weight FROM w""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "reasoning").where("reasoning is not null").select("trace_id", alpha_tokens(F.col("reasoning")).alias("tokens"))
    return ml.tfidf(t, "trace_id", "tokens").withColumn("weight", F.round("weight", 6))


DEPTHS = (10, 25, 50, 75, 100)


def _scored(df: DataFrame, names: tuple[str, ...] = ("score",)) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[F.round(c, 9).alias(c) for c in names])


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).withColumn("x", F.array(log_length(fallback_text(F.col("reasoning"), F.col("model_response")))))


@query()
def length_scores(spark: SparkSession, d: str) -> DataFrame:
    t = fo.folded(_lengths(spark, d), "problem_id", by="stride")
    return _scored(fo.out_of_fold(t, "trace_id", "correct", "x", kind="logistic", least=10))


@query()
def length_scores_within(spark: SparkSession, d: str) -> DataFrame:
    t = fo.folded(_lengths(spark, d), "problem_id", by="stride")
    return _scored(fo.out_of_fold(t, "trace_id", "correct", "x", kind="logistic", group="dataset", least=10))


def _operators(spark: SparkSession, d: str, by: str = "stride", depths: tuple[int, ...] = (100,), rounding: str = "ceil", words: bool = False) -> DataFrame:
    """Labelled traces with operators, at each of ``depths``: ``fold``, their features ``x`` and with ``words`` the ``tokens`` of their
    spans' anchors (else of the end of the text), of the first ``depth`` percent of the spans.

    Traces are read once for all depths; what other queries take from them is held.
    """
    t = traces(spark, d, "model", "dataset", "problem_id", "correct", "spans", *(["reasoning", "model_response"] if words else [])).where("correct is not null and exists(spans.cluster, c -> c <> -1)")
    said = lambda text: F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), " ")
    # of each span: null without an anchor, empty without words
    part = F.transform("spans", lambda s: F.struct(s["cluster"].alias("cluster"), (F.when(s["anchor"] != "", said(F.left(s["anchor"], F.lit(80)))) if words else F.lit("")).alias("words")))
    n = F.size("spans")
    kept = lambda depth: F.greatest(F.lit(1), F.ceil(n * depth / 100) if rounding == "ceil" else F.floor(n * depth / 100)).cast("int")
    without = lambda spans: ~F.exists(spans, lambda s: F.coalesce(s["anchor"] != "", F.lit(False)))
    # the end of the text is needed only where the least depth has no anchors
    end = F.when(without(F.slice("spans", 1, kept(min(depths)))), said(F.right(fallback_text(F.col("model_response"), F.col("reasoning")), F.lit(3000)))) if words else F.lit("")
    own = ["trace_id", "model", "dataset", "problem_id", "correct"]
    t = held(t.select(*own, part.alias("spans"), end.alias("end")))
    t = fo.folded(t, "problem_id", by=by) if by else t
    t = t.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("part", F.slice("spans", 1, kept(F.col("depth"))))
    each = F.col("part.words")
    found = F.when(F.exists(each, lambda w: w.isNotNull()), F.array_join(F.filter(each, lambda w: w != ""), " ")).otherwise(F.col("end"))
    t = t.select(*own, "depth", *(["fold"] if by else []), found.alias("words"), F.col("part.cluster").alias("operator_sequence"))
    return s.with_features(t, operators(spark, d)).withColumn("tokens", F.split("words", " ")).drop("words")


def _trees(rows: DataFrame, **options) -> DataFrame:
    return fo.out_of_fold(rows, "trace_id", "correct", "x", kind="boosted", **options)


@query()
def operator_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_trees(_operators(spark, d), least=20))


@query()
def operator_scores_within(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_trees(_operators(spark, d), group="dataset", least=20))


@query()
def operator_word_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_trees(_operators(spark, d, words=True), tokens="tokens", least=20))


def _early(spark: SparkSession, d: str) -> DataFrame:
    """(trace_id, dataset, problem_id, correct, depth, score): fitted anew at each depth, on operators and words."""
    return _trees(_operators(spark, d, depths=DEPTHS, words=True), group="depth", tokens="tokens", least=20, carry=("dataset", "problem_id", "correct", "depth"))


@query()
def early_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_early(spark, d).select("trace_id", "depth", "score"))


@query()
def early_summary(spark: SparkSession, d: str) -> DataFrame:
    """The within-problem AUC of each depth, of all traces and by dataset where it has five or more."""
    e = held(_early(spark, d).where("score is not null"))
    whole = m.within_auc(e, ["depth"], ["problem_id"], F.col("correct"), F.col("score")).withColumn("dataset", F.lit("all"))
    enough = e.groupBy(F.col("dataset").alias("_d")).agg((F.count("*") / len(DEPTHS)).alias("n")).where("n >= 5").select("_d")
    each = m.within_auc(e.join(enough, F.col("dataset") == F.col("_d"), "left_semi"), ["depth", "dataset"], ["problem_id"], F.col("correct"), F.col("score"))
    return whole.unionByName(each).select("depth", "dataset", F.round("wp_auc", 4).alias("wp_auc"), "n_groups")


def _fold_means(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, deviation, folds): of the folds' within-problem AUC."""
    per = m.within_auc(scored.where("score is not null"), [*keys, "fold"], ["problem_id"], F.col("correct"), F.col("score"))
    return m.fold_means(per, keys, "wp_auc")


@query()
def early_curve(spark: SparkSession, d: str) -> DataFrame:
    return _fold_means(_trees(_operators(spark, d, "split", DEPTHS), group="depth", carry=("problem_id", "correct", "depth", "fold")), ["depth"])


def _cells(spark: SparkSession, d: str, keys: list[str], least: int) -> DataFrame:
    """Rows of the groups of ``keys`` with enough rows, both labels and four problems, fitted and scored group by group."""
    rows = held(_operators(spark, d, "").drop("tokens")).withColumn("cell", F.concat_ws("/", *keys))
    fit = rows.groupBy(F.col("cell").alias("_c")).agg(F.count("*").alias("n"), F.count_distinct("correct").alias("k"), F.count_distinct("problem_id").alias("p")).where(f"n >= {least} and k > 1 and p >= 4")
    kept = rows.join(fit, F.col("cell") == F.col("_c"), "left_semi")
    return _fold_means(_trees(fo.folded(kept, "problem_id", group="cell"), group="cell", carry=(*keys, "problem_id", "correct", "fold")), keys)


@query()
def cell_scores(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, ["model", "dataset"], 20)


@query()
def dataset_fits(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, ["dataset"], 40)


@query()
def whole_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = _operators(spark, d, "split").withColumn("all", F.lit("all"))
    return _fold_means(_trees(rows, carry=("all", "problem_id", "correct", "fold")), ["all"])


@query()
def model_identification(spark: SparkSession, d: str) -> DataFrame:
    rows = held(_operators(spark, d, "plain").select("trace_id", "model", "fold", "x"))
    names = sorted(r[0] for r in rows.where("model is not null").select("model").distinct().collect())  # few; what has no bound are their models, checked by size
    got = fo.out_of_fold(rows, "trace_id", "model", "x", kind="boosted", classes=names, carry=("model",))
    known = got.where("probs is not null").withColumn("names", F.array(*map(F.lit, names)))
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    return known.select("trace_id", F.col("model").alias("true"), F.element_at("names", best).alias("pred"), F.round(F.array_max("probs"), 9).alias("prob"), F.map_from_arrays("names", "probs").alias("probs"))


@query()
def model_confusion(spark: SparkSession, d: str) -> DataFrame:
    return m.confusion(model_identification(spark, d), "true", "pred")


@query()
def model_class_scores(spark: SparkSession, d: str) -> DataFrame:
    return m.class_scores(held(m.confusion(model_identification(spark, d), "true", "pred")))  # read twice, scored once


@query()
def model_auc(spark: SparkSession, d: str) -> DataFrame:
    each = model_identification(spark, d).select("true", F.explode("probs").alias("cls", "prob"))
    return m.one_vs_rest(each, "true", "cls", "prob").select("cls", F.round("auc", 9).alias("auc"))


@query()
def pairwise_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each trace at five depths by the ranker that was fitted to the other folds' whole traces."""
    got = fo.out_of_fold(_operators(spark, d, "plain", DEPTHS, "floor"), "trace_id", "correct", "x", kind="ranker", problem="problem_id", carry=("depth",), train="depth = 100", least=20)
    return got.groupBy("trace_id").pivot("depth", list(DEPTHS)).agg(F.round(F.max("score"), 9)).select("trace_id", *[F.col(str(p)).alias(f"d{p}") for p in DEPTHS])


def _openers(spark: SparkSession, d: str) -> DataFrame:
    n = spans(spark, d, "ngram").where("ngram is not null and ngram <> ''").select(F.lower("ngram").alias("ngram")).distinct()
    return char_ngram_vectors(n, "ngram")


@query()
def opener_clusters(spark: SparkSession, d: str) -> DataFrame:
    found, _ = ml.cluster(_openers(spark, d), "ngram", "x", 7)
    return found.select("ngram", "cluster")


@query()
def cluster_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ml.cluster_sweep(_openers(spark, d), "ngram", "x", [5, 6, 7, 8, 9, 10]).select("k", F.round("cost", 6).alias("cost"), F.round("silhouette", 6).alias("silhouette"))


@query()
def naming_sweep(spark: SparkSession, d: str) -> DataFrame:
    """(k, clusters, named, n, agreement, kappa): at each size the clusters are named by a model from their openers, two models
    label openers by the names, and their agreement is measured. Stand-ins answer here."""
    x = held(_openers(spark, d))
    out = None
    for k, (_, found) in sorted(ml.centres(x, "ngram", "x", [6, 7, 8]).items()):
        own = held(ml.assigned(x, "x", found).select("ngram", "cluster"))
        first = top_per_group(own.withColumn("n", F.lit(1)), "cluster", "ngram", "n", 5).groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("ngram")), "; ").alias("prompt"))
        named = judge.ask(first.withColumn("cluster", F.col("cluster").cast("string")), "cluster", "prompt", lambda: judge.Stub({"wait": "NAME: doubt", "so": "NAME: infer"}, "NAME: other"))
        names = named.select(F.col("cluster").cast("int").alias("cluster"), F.upper(F.regexp_extract("reply", r"NAME:\s*(.+)", 1)).alias("name"))
        asked = own.join(F.broadcast(names), "cluster").withColumn("prompt", F.col("ngram"))  # a row for each cluster
        a = judge.ask(asked, "ngram", "prompt", lambda: judge.Stub({"wait": "DOUBT", "so": "INFER"}, "OTHER")).select("ngram", F.col("reply").alias("true"))
        b = judge.ask(asked, "ngram", "prompt", lambda: judge.Stub({"wait": "DOUBT", "then": "INFER"}, "OTHER")).select("ngram", F.col("reply").alias("pred"))
        both = m.kappa(m.confusion(a.join(b, "ngram"), "true", "pred"))
        row = both.select(F.lit(k).alias("k"), F.lit(len(found)).alias("clusters"), "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {TR} SELECT model, dataset, count(*) AS total, count(correct) AS labelled, count(*) FILTER (correct) / nullif(count(correct), 0) AS accuracy FROM tr GROUP BY ALL")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.run_summary(traces(spark, d, "model", "dataset", "correct"))


@query(f"WITH {TR} SELECT trace_id, CASE WHEN contains(coalesce(model_response, ''), 'boxed') THEN 1 END AS verdict FROM tr")
def judged_responses(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.grading import verdict

    t = traces(spark, d, "model_response").select("trace_id", F.coalesce("model_response", F.lit("")).alias("prompt"))
    return judge.ask(t, "trace_id", "prompt", lambda: judge.Stub({"boxed": "CORRECT"})).select("trace_id", verdict(F.col("reply")).alias("verdict"))



@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("value", F.round("value", 4))


