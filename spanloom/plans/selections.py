"""Queries of selections, keys, joins, sets and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import profiles, sampling, traces as tr_ops
from spanloom.operators.metrics import ranked_by
from spanloom.operators.pivots import assembled, fold
from spanloom.plans.tables import DROP_DATASETS, PR, SCORES, SP, TR, WS, predictions, spans, table, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REASON = "CASE WHEN model IN ('cobble-mix') THEN 'model' WHEN dataset IN ('bbh','humaneval','arc_agi2') THEN 'dataset' WHEN coalesce(truncated, false) THEN 'truncated' WHEN correct IS NULL THEN 'unlabelled' END"


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "model", "dataset", "problem_id", "sample", "truncated", "correct")
    return t.withColumn("reason", tr_ops.corpus_reason(["cobble-mix"], DROP_DATASETS))


@query(f"WITH {TR} SELECT trace_id, {_REASON} AS reason FROM tr")
def corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    return _reasoned(spark, d).select("trace_id", "reason")


@query(f"WITH {TR} SELECT {_REASON} AS reason, count(*) AS n FROM tr GROUP BY 1")
def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reasoned(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {TR} SELECT trace_id, model, dataset, problem_id, correct FROM tr WHERE dataset NOT IN ('bbh','humaneval','arc_agi2') AND correct IS NOT NULL AND len(operator_sequence) > 0")
def labelled_scan(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "model", "dataset", "problem_id", "correct", "operator_sequence")
    return tr_ops.labelled(t, DROP_DATASETS, need_sequence=True).drop("operator_sequence")


@query(f"WITH {TR} SELECT trace_id, model, coalesce(correct, false) AS correct FROM tr WHERE len(operator_sequence) > 0")
def model_id_scan(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "model", "correct", "operator_sequence").where(F.size("operator_sequence") > 0)
    return t.select("trace_id", "model", F.coalesce("correct", F.lit(False)).alias("correct"))


@query(f"WITH {TR} SELECT model, model_family, count(*) AS n FROM tr WHERE model IN ('marlow-think-70b','tessel-r2','quillon-pro') GROUP BY ALL")
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "model", "model_family").where(F.col("model").isin("marlow-think-70b", "tessel-r2", "quillon-pro"))
    return t.groupBy("model", "model_family").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT coalesce(nullif(trace_id, ''), concat_ws('__', model, dataset, problem_id, 's' || sample::VARCHAR)) AS trace_key FROM final_dataset")
def key_synthesis(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "final_dataset").select("trace_id", "model", "dataset", "problem_id", "sample")
    return t.select(tr_ops.trace_key().alias("trace_key")).distinct()


@query(f"WITH {TR}, {PR} SELECT trace_id, dataset FROM tr WHERE NOT coalesce(truncated, false) AND dataset NOT IN ('codelore') AND trace_id NOT IN (SELECT trace_id FROM pr WHERE trace_id IS NOT NULL AND correct IS NOT NULL) ORDER BY trace_id LIMIT 40")
def grading_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "truncated", "dataset")
    return tr_ops.candidates(t, predictions(spark, d).where("correct is not null"), skip=["codelore"], limit=40).select("trace_id", "dataset")


@query(f"WITH {TR} SELECT trace_id, dataset, model FROM tr WHERE correct IS NOT NULL AND dataset NOT IN ('bbh','humaneval','arc_agi2') AND dataset IN ('numera', 'gatewise') AND model IN ('tessel-r2', 'quillon-pro', 'oxbow-32b')")
def judge_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "dataset", "model", "correct")
    kept = tr_ops.labelled(t, DROP_DATASETS)
    return kept.where(tr_ops.listed("dataset", "numera, gatewise") & tr_ops.listed("model", "tessel-r2,quillon-pro, oxbow-32b")).select("trace_id", "dataset", "model")


_REGISTRY = [("tessel-r2", "lab/tessel-r2-0711", "hosted"), ("quillon-pro", "quillon-pro-2", "direct"), ("oxbow-32b", "oxbow-32b-old", "hosted"), ("cobble-mix", "cobble", "hosted")]
_FIXES = {"oxbow-32b-old": "works/oxbow-32b", "fennel-9b": "works/fennel-9b"}


@query("""WITH r(model, id, backend) AS (VALUES ('tessel-r2', 'lab/tessel-r2-0711', 'hosted'), ('quillon-pro', 'quillon-pro-2', 'direct'), ('oxbow-32b', 'oxbow-32b-old', 'hosted'), ('cobble-mix', 'cobble', 'hosted')),
f(a, b) AS (VALUES ('oxbow-32b-old', 'works/oxbow-32b'), ('fennel-9b', 'works/fennel-9b')), m AS (SELECT DISTINCT model FROM final_dataset), j AS (SELECT m.model, coalesce(x.b, r.id, y.b, m.model) AS id, r.backend FROM m LEFT JOIN r USING (model) LEFT JOIN f x ON x.a = r.id LEFT JOIN f y ON y.a = m.model AND r.id IS NULL)
SELECT model, CASE WHEN model = 'cobble-mix' THEN NULL WHEN backend = 'direct' AND NOT contains(id, '/') THEN 'direct/' || id ELSE id END AS model_id FROM j""")
def model_ids(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame(_REGISTRY, "model string, id string, backend string")
    m = table(spark, d, "final_dataset").select("model").distinct()
    return tr_ops.remapped(m, registry, _FIXES, skip=["cobble-mix"], prefixed="direct")


@query("""WITH u AS (SELECT problem_id, min(answer) AS a FROM problems GROUP BY 1)
SELECT DISTINCT f.trace_id, coalesce(f.gold_answer, u.a) AS gold_answer FROM final_dataset f LEFT JOIN u ON f.problem_id = u.problem_id""")
def field_backfill(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "final_dataset").select("trace_id", "problem_id", "gold_answer")
    p = table(spark, d, "problems").select("problem_id", F.col("answer").alias("gold_answer"))
    return tr_ops.backfill(t, p, "problem_id", ["gold_answer"]).select("trace_id", "gold_answer").distinct()


@query(f"""WITH {TR}, u AS (SELECT problem_id AS k, min(answer) AS a FROM problems GROUP BY 1), w AS (SELECT problem AS k, min(answer) AS a FROM problems GROUP BY 1)
SELECT trace_id, coalesce(u.a, w.a) AS answer FROM tr LEFT JOIN u ON tr.problem_id = u.k LEFT JOIN w ON tr.problem = w.k""")
def lookup_two_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems")
    both = p.select(F.col("problem_id").alias("k"), "answer").unionByName(p.select(F.col("problem").alias("k"), "answer"))
    return tr_ops.either_key(traces(spark, d, "problem_id", "problem"), both, ("problem_id", "problem"), "k", "answer", "out").select("trace_id", F.col("out").alias("answer"))


_TEMPLATES = [("numera", "Solve it. The answer is a whole number from 0 to 999.\n\n{problem}"), ("gatewise", "Choose one.\n\n{problem}\n\nThe answer is (X)."), (None, "Solve: {problem}")]


@query(f"""WITH {TR} SELECT trace_id, CASE WHEN contains(model, 'think') THEN '/think' || chr(10) ELSE '' END || CASE dataset WHEN 'numera' THEN 'Solve it. The answer is a whole number from 0 to 999.' || chr(10) || chr(10) || problem
 WHEN 'gatewise' THEN 'Choose one.' || chr(10) || chr(10) || problem || chr(10) || chr(10) || 'The answer is (X).' ELSE 'Solve: ' || problem END AS prompt FROM tr WHERE problem IS NOT NULL""")
def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    templates = spark.createDataFrame(_TEMPLATES, "dataset string, template string")
    t = traces(spark, d, "problem", "dataset", "model").where("problem is not null")
    return tr_ops.prompts(t, templates, F.contains("model", F.lit("think"))).select("trace_id", "prompt")


@query(f"WITH {TR}, {SP} SELECT sp.trace_id, span_idx, 'Which of these operators is the sentence? Give the numbers of the best and the second best.' || chr(10) || '1. OPEN' || chr(10) || '2. DOUBT' || chr(10) || 'Sentence: ' || anchor AS prompt FROM sp WHERE anchor IS NOT NULL")
def label_prompts(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.sources.judge import label_prompt

    return spans(spark, d, "anchor").where("anchor is not null").select("trace_id", "span_idx", label_prompt(F.col("anchor"), ["OPEN", "DOUBT"]).alias("prompt"))


@query("SELECT DISTINCT problem_id, replace(url, '/', '_') AS file FROM problems WHERE url IS NOT NULL")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.text import safe_name

    return table(spark, d, "problems").where("url is not null").select("problem_id", safe_name(F.col("url")).alias("file")).distinct()


@query(f"WITH {SP}, g AS (SELECT trace_id, count(*) AS n_spans, string_agg(cluster::VARCHAR, '>' ORDER BY span_idx) AS clusters FROM sp GROUP BY 1), {TR} SELECT tr.trace_id, coalesce(g.n_spans, 0) AS n_spans, coalesce(g.clusters, '') AS clusters FROM tr LEFT JOIN g USING (trace_id)")
def traces_with_spans(spark: SparkSession, d: str) -> DataFrame:
    g = spans(spark, d, "cluster").groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.sort_array(F.collect_list(F.struct("span_idx", "cluster"))).alias("s"))
    joined = traces(spark, d, "sample").join(g, "trace_id", "left")
    text = F.array_join(F.transform("s", lambda x: x["cluster"].cast("string")), ">")
    return joined.select("trace_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce(text, F.lit("")).alias("clusters"))


_FOLD = f"""WITH {SP}, m AS (SELECT *, coalesce(cluster >= 0, false) AS opens FROM sp),
k AS (SELECT *, (sum(opens::INT) OVER (PARTITION BY trace_id ORDER BY span_idx) - 1)::INT AS op_idx FROM m),
z AS (SELECT trace_id, op_idx, max(CASE WHEN opens THEN cluster END) AS cluster, max(CASE WHEN opens THEN anchor END) AS anchor,
  coalesce(string_agg(CASE WHEN NOT opens THEN trim(concat_ws(' ', anchor, array_to_string(body, ' '))) END, chr(10) ORDER BY span_idx), '') AS continuation FROM k GROUP BY ALL)
"""


@query(_FOLD + "SELECT trace_id, op_idx, cluster, anchor, continuation FROM z")
def span_folding(spark: SparkSession, d: str) -> DataFrame:
    f = fold(spans(spark, d, "cluster", "anchor", "body"))
    return f.select("trace_id", "op_idx", "cluster", "anchor", F.array_join("continuation", "\n").alias("continuation"))


@query(_FOLD + f", {TR}, g AS (SELECT trace_id, count(*) FILTER (op_idx >= 0) AS n_ops, string_agg(cluster::VARCHAR, '>' ORDER BY op_idx) FILTER (op_idx >= 0) AS ops FROM z GROUP BY 1) SELECT tr.trace_id, coalesce(n_ops, 0) AS n_ops, coalesce(ops, '') AS ops FROM tr LEFT JOIN g USING (trace_id)")
def assembled_dataset(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "model", "dataset")
    a = assembled(t, fold(spans(spark, d, "cluster", "anchor", "body")), table(spark, d, "cluster_names"))
    return a.select("trace_id", F.size("operator_sequence").cast("long").alias("n_ops"), F.array_join(F.col("operator_sequence").cast("array<string>"), ">").alias("ops"))


@query(f"WITH {SP} SELECT trace_id, span_idx, cluster, lag(cluster) OVER (PARTITION BY trace_id ORDER BY span_idx) AS prev_cluster, lag(anchor) OVER (PARTITION BY trace_id ORDER BY span_idx) AS prev_anchor FROM sp")
def prior_span(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("trace_id").orderBy("span_idx")
    s = spans(spark, d, "cluster", "anchor")
    return s.select("trace_id", "span_idx", "cluster", F.lag("cluster").over(order).alias("prev_cluster"), F.lag("anchor").over(order).alias("prev_anchor"))


@query(f"WITH {SP} SELECT trace_id, span_idx, coalesce(n.name, 'structural') AS operator FROM sp LEFT JOIN cluster_names n USING (cluster)")
def named_spans(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "cluster_names").select("cluster", "name")
    return spans(spark, d, "cluster").join(n, "cluster", "left").select("trace_id", "span_idx", F.coalesce("name", F.lit("structural")).alias("operator"))


@query("WITH m AS (SELECT DISTINCT model FROM final_dataset), s AS (SELECT DISTINCT dataset FROM final_dataset), c AS (SELECT model, dataset, count(DISTINCT trace_id) AS n FROM final_dataset GROUP BY ALL) SELECT m.model, s.dataset, coalesce(c.n, 0) AS n FROM m, s LEFT JOIN c ON c.model = m.model AND c.dataset = s.dataset")
def model_dataset_grid(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "final_dataset").select("trace_id", "model", "dataset").distinct()
    counts = t.groupBy("model", "dataset").agg(F.count("*").alias("n"))
    # every dataset's name beside every model: one array of names, a row for each model
    names = counts.agg(F.collect_set("dataset")).scalar()
    grid = counts.select("model").distinct().select("model", F.explode(names).alias("dataset"))
    return grid.join(counts, ["model", "dataset"], "left").select("model", "dataset", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {TR}, o AS (SELECT problem_id, trace_id, correct, row_number() OVER (PARTITION BY problem_id, correct ORDER BY md5('42:' || trace_id), trace_id) - 1 AS i FROM tr WHERE correct IS NOT NULL),
c AS (SELECT * FROM o WHERE i < 16), n AS (SELECT problem_id, count(*) FILTER (correct) AS p, count(*) FILTER (NOT correct) AS q FROM c GROUP BY 1),
j AS (SELECT problem_id, p, q, unnest(range(0, 16)) AS j FROM n WHERE p > 0 AND q > 0)
SELECT j.problem_id, a.trace_id AS pos, b.trace_id AS neg FROM j JOIN c a ON a.problem_id = j.problem_id AND a.correct AND a.i = j.j % j.p JOIN c b ON b.problem_id = j.problem_id AND NOT b.correct AND b.i = j.j % j.q""")
def contrast_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.contrast_pairs(traces(spark, d, "problem_id", "correct"), "problem_id", "trace_id", "correct")


@query(f"WITH {TR} SELECT trace_id, (('0x' || substr(md5('42:' || problem_id), 1, 8))::UBIGINT % 5)::INT AS fold FROM tr")
def problem_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.with_fold(traces(spark, d, "problem_id"), "problem_id").select("trace_id", "fold")


@query(f"WITH {TR} SELECT trace_id FROM tr ORDER BY md5('42:' || trace_id), trace_id LIMIT 100")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(traces(spark, d, "sample").select("trace_id"), "trace_id", 100)


@query(f"WITH {TR} SELECT model, trace_id, rank FROM (SELECT model, trace_id, row_number() OVER (PARTITION BY model ORDER BY md5('42:' || trace_id), trace_id) AS rank FROM tr) WHERE rank <= 5")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced(traces(spark, d, "model").select("model", "trace_id"), ["model"], "trace_id", 5)


@query(f"""WITH {TR}, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT model, correct FROM tr))
SELECT model, correct, trace_id, rank FROM (SELECT model, correct, trace_id, row_number() OVER (PARTITION BY model, correct ORDER BY md5('42:' || trace_id), trace_id) AS rank FROM tr), c WHERE rank <= greatest(1, 200 // c.n)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(traces(spark, d, "model", "correct").select("model", "correct", "trace_id"), ["model", "correct"], "trace_id", 200)


@query(f"WITH {TR} SELECT trace_id, row_number() OVER (ORDER BY md5('42:' || trace_id), trace_id) - 1 AS rank FROM tr")
def shuffled_traces(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "sample").where("trace_id is not null").select("trace_id", tr_ops.hash_order("42", "trace_id").alias("h"))
    return ranked_by(t, "h", "trace_id").select("trace_id", "rank")


@query(f"WITH {SP}, o AS (SELECT cluster, trace_id, span_idx, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:' || trace_id || ':' || span_idx), trace_id, span_idx) AS r FROM sp WHERE cluster >= 0) SELECT cluster, trace_id, span_idx FROM o WHERE r BETWEEN 4 AND 9")
def held_out_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Of each cluster six exemplars that aren't among the three test spans: the pool less the test set, by trace and span."""
    pool = spans(spark, d, "cluster").where("cluster >= 0").select("cluster", "trace_id", "span_idx", F.struct(tr_ops.hash_order("42", "trace_id", "span_idx"), "trace_id", "span_idx").alias("o")).withColumn("n", F.lit(1))
    from pyspark.sql import Window

    first = lambda df, k: df.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("o"))).where(F.col("r") <= k)
    test = first(pool, 3).select("trace_id", "span_idx")
    return first(pool.join(test, ["trace_id", "span_idx"], "left_anti"), 6).select("cluster", "trace_id", "span_idx")


@query(f"""WITH {SP} SELECT cluster, trace_id, span_idx, rank FROM (SELECT cluster, trace_id, span_idx, row_number() OVER (PARTITION BY cluster ORDER BY trace_id, span_idx) AS rank FROM sp WHERE cluster >= 0) WHERE rank <= 5""")
def cluster_exemplars(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.pivots import exemplars

    return exemplars(spans(spark, d, "cluster"), 5).select("cluster", "trace_id", "span_idx", "rank")


@query(f"""WITH {SP}, w AS (SELECT cluster, nullif(regexp_extract(lower(anchor), '^[{WS}]*([^{WS}]+)', 1), '') AS first, trace_id, span_idx FROM sp WHERE cluster >= 0),
v AS (SELECT cluster, regexp_replace(first, '[.,!?;:''"]+$', '') AS word, trace_id, span_idx FROM w)
SELECT cluster, word, trace_id, span_idx FROM (SELECT *, row_number() OVER (PARTITION BY cluster, word ORDER BY trace_id, span_idx) AS r FROM v) WHERE r = 1""")
def first_span_by_word(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.text import first_word

    s = spans(spark, d, "cluster", "anchor").where("cluster >= 0")
    w = s.select("cluster", first_word(F.col("anchor")).alias("word"), F.struct("trace_id", "span_idx").alias("at"))
    return w.groupBy("cluster", "word").agg(F.min("at").alias("at")).select("cluster", "word", "at.*")


_TWO = "u AS (SELECT trace_id, 1 AS file, d100 AS score FROM predictions WHERE dataset < 'm' AND d100 IS NOT NULL UNION ALL SELECT trace_id, 2, op_cross FROM predictions WHERE dataset > 'd' AND op_cross IS NOT NULL)"


def _two_files(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two overlapping files, as one table; each keeps the rows that have its score."""
    p = table(spark, d, "predictions")
    a = p.where("dataset < 'm' and d100 is not null").select("trace_id", F.lit(1).alias("file"), F.col("d100").alias("score"))
    return a.unionByName(p.where("dataset > 'd' and op_cross is not null").select("trace_id", F.lit(2).alias("file"), F.col("op_cross").alias("score")))


@query(f"WITH {_TWO} SELECT trace_id, file, score FROM u")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return _two_files(spark, d)


@query(f"WITH {_TWO} SELECT trace_id, file, max(score) AS score FROM (SELECT *, max(file) OVER (PARTITION BY trace_id) AS last FROM u) WHERE file = last GROUP BY ALL")
def union_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return tr_ops.latest(_two_files(spark, d), "file", "score", by=("file", "score"))


@query(f"WITH {SP}, e AS (SELECT DISTINCT lower(ngram) AS ngram, md5(lower(ngram)) AS v FROM sp WHERE ngram IS NOT NULL AND length(ngram) > 6), c AS (SELECT lower(ngram) AS ngram, min(cluster) AS cluster FROM sp WHERE cluster >= 0 AND ngram IS NOT NULL GROUP BY 1) SELECT ngram, cluster, v FROM c JOIN e USING (ngram)")
def phrase_vectors(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d, "cluster", "ngram").where("ngram is not null")
    vectors = s.where(F.length("ngram") > 6).select(F.lower("ngram").alias("ngram"), F.md5(F.lower("ngram")).alias("v")).distinct()  # stand-ins for embeddings
    clusters = s.where("cluster >= 0").groupBy(F.lower("ngram").alias("ngram")).agg(F.min("cluster").alias("cluster"))
    return clusters.join(vectors, "ngram").select("ngram", "cluster", "v")


@query("""WITH p AS (SELECT DISTINCT problem_id, test_cases AS j FROM problems WHERE test_cases IS NOT NULL AND test_cases <> '') SELECT problem_id, json_array_length(j) AS n, json_extract_string(j, '$[0].input') AS input, json_extract_string(j, '$[0].output') AS output,
 '{"input":' || to_json(json_extract_string(j, '$[0].input')) || ',"output":' || to_json(json_extract_string(j, '$[0].output')) || '}' AS first FROM p""")
def nested_answers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").where("test_cases <> ''").select("problem_id", "test_cases").distinct()
    cases = F.from_json("test_cases", "array<struct<input:string,output:string>>")
    first = F.get(cases, F.lit(0))
    return p.select("problem_id", F.size(cases).cast("bigint").alias("n"), first["input"].alias("input"), first["output"].alias("output"), F.to_json(first).alias("first"))


@query(f"WITH {TR} SELECT DISTINCT trace_id FROM tr WHERE trace_id NOT IN (SELECT trace_id FROM spans_clustered)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return tr_ops.not_done(traces(spark, d, "sample").select("trace_id"), table(spark, d, "spans_clustered"))


@query("SELECT dataset FROM (SELECT DISTINCT dataset FROM final_dataset INTERSECT SELECT DISTINCT dataset FROM predictions)")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_dataset").select("dataset").intersect(table(spark, d, "predictions").select("dataset"))


@query(f"WITH {TR} SELECT trace_id, array_to_string(list_slice(list_concat(list_transform(coalesce(operator_sequence, []), lambda x: coalesce(x::VARCHAR, 'n')), list_transform(range(0, 512), lambda x: '-2')), 1, 512), ' ') AS ids FROM tr")
def padded_sequences(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.sequences import padded

    seq = F.coalesce("operator_sequence", F.array().cast("array<int>"))
    return traces(spark, d, "operator_sequence").select("trace_id", F.array_join(padded(seq, 512, -2).cast("array<string>"), " ", "n").alias("ids"))


_LEADS = f"""WITH {TR}, {PR} SELECT tr.trace_id, tr.dataset, tr.model, {', '.join('pr.' + s for s in SCORES)} FROM tr LEFT JOIN pr USING (trace_id)"""


@query(_LEADS)
def merged_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).select("trace_id", *SCORES)
    return traces(spark, d, "dataset", "model").join(p, "trace_id", "left").select("trace_id", "dataset", "model", *SCORES)


@query(f"""WITH {TR}, g AS (SELECT grouping_id(dataset, model) AS gid, dataset, model, count(*) AS total, count(*) FILTER (correct) AS correct FROM tr GROUP BY GROUPING SETS ((dataset), (model), ()))
SELECT CASE gid WHEN 1 THEN 'dataset' WHEN 2 THEN 'model' ELSE 'all' END AS by, CASE gid WHEN 1 THEN dataset WHEN 2 THEN model END AS name, total, correct, correct / total AS rate FROM g""")
def rates(spark: SparkSession, d: str) -> DataFrame:
    return profiles.rates(traces(spark, d, "dataset", "model", "correct"))


@query(f"WITH {TR} SELECT dataset, count(*) AS total, count(*) FILTER (correct) AS yes, count(*) FILTER (NOT correct) AS no, count(*) FILTER (correct IS NULL) AS unclear, count(*) FILTER (correct) / greatest(count(*) - count(*) FILTER (correct IS NULL), 1) AS share FROM tr GROUP BY 1")
def graded_counts(spark: SparkSession, d: str) -> DataFrame:
    return profiles.graded_counts(traces(spark, d, "dataset", "correct"), "dataset", "correct")


@query(f"WITH {TR} SELECT dataset, count(*) AS n, avg(correct::INT) AS rate, median(length(reasoning)) AS median_length, count(DISTINCT problem_id) AS problems, count(*) / count(DISTINCT problem_id) AS per_problem FROM tr GROUP BY 1")
def dataset_comparison(spark: SparkSession, d: str) -> DataFrame:
    return profiles.dataset_comparison(traces(spark, d, "dataset", "correct", "problem_id", "reasoning"), F.length("reasoning"))


