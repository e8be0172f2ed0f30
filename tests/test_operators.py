"""Sequences, metrics, pivots, samples and learners on small cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import boosting
from spanloom.operators import metrics as m
from spanloom.operators import pivots as pv
from spanloom.operators import sampling, sequences as s, traces as tr
from spanloom.operators.boosting import Boosted
from spanloom.operators.vectors import cosine
from spanloom.operators.folds import folded, out_of_fold
from spanloom.operators.jvm import grown
from spanloom.plans import learned


def ev(spark, seqs):
    return s.entries(spark.createDataFrame([(f"t{i}", q) for i, q in enumerate(seqs)], "trace_id string, operator_sequence array<int>"))


def test_features(spark):
    got = {r.feature: r.value for r in s.features(ev(spark, [[0, 0, 1], [], None, [-1]])).collect()}
    assert got["freq_0"] == pytest.approx(2 / 3) and got["repeats"] == 0.5
    assert got["bigram_0_0"] == got["bigram_0_1"] == 0.5
    assert got["run_mean_0"] == pytest.approx(2 / 3) and got["run_max_1"] == pytest.approx(1 / 3)
    assert got["quarter_0_0"] == got["quarter_1_0"] == got["quarter_2_1"] == 1 and not any(k.startswith("quarter_3") for k in got)
    assert len(s.feature_names(list(range(7)))) == 117


def test_feature_sums(spark):
    rnd = random.Random(5)
    seqs = [[rnd.randrange(5) for _ in range(rnd.randint(2, 30))] for _ in range(20)]
    e = ev(spark, seqs)
    assert all(abs(r.v - 1) < 1e-9 for r in s.frequencies(e).groupBy("trace_id").agg(F.sum("value").alias("v")).collect())
    assert all(abs(r.v - 1) < 1e-9 for r in s.bigrams(e).groupBy("trace_id").agg(F.sum("value").alias("v")).collect())
    assert all(r.v == r.n for r in s.runs(e).groupBy("trace_id").agg(F.sum("length").alias("v"), F.max("n").alias("n")).collect())
    want = [len(list(g)) for _, g in itertools.groupby(seqs[0])]
    assert [r.length for r in s.runs(e).where("trace_id = 't0'").orderBy("start").collect()] == want


def test_depth(spark):
    e = ev(spark, [[0] * 7])
    assert s.prefix(e, 75, "ceil").count() == 6 and s.prefix(e, 75).count() == 5 and s.prefix(e, 1).count() == 1


def brute_auc(rows):
    pos, neg = [x for y, x in rows if y == 1 and x is not None], [x for y, x in rows if y == 0 and x is not None]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([0, 1, None]), rnd.choice([None, *[k / 7 for k in range(8)]])) for _ in range(300)] + [("d", 1, 0.5), ("d", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r.auc for r in m.auc(df, ["g"], F.col("y"), F.col("s")).collect()}
    for k in ("a", "b", "c", None, "d"):
        want = brute_auc([(y, x) for g, y, x in rows if g == k])
        assert got[k] == (None if want is None else pytest.approx(want))
    assert m.auc(df.limit(0), ["g"], F.col("y"), F.col("s")).count() == 0


def test_within_auc(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), ("b", 1, 0.4), ("c", 0, 0.8), ("c", 1, 0.2)], "p string, y int, s double")
    r = m.within_auc(df, [], ["p"], F.col("y"), F.col("s")).first()
    assert r.wp_auc == 0.5 and r.n_groups == 2


def test_kappa(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, p int")
    assert m.kappa(m.confusion(df, "t", "p")).first().kappa == pytest.approx(0.5)


def test_folding(spark):
    rows = [("t", 0, -1, "a", ["b"]), ("t", 1, 2, "c", []), ("t", 2, -1, "d", None), ("t", 3, 0, "e", []), ("t", 3, 0, "e", [])]
    sp = pv.one_span(spark.createDataFrame(rows, "trace_id string, span_idx int, cluster int, anchor string, body array<string>"), "cluster", "anchor", "body")
    got = {r.op_idx: (r.cluster, r.anchor, list(r.continuation)) for r in pv.fold(sp).collect()}
    assert got == {-1: (None, None, ["a b"]), 0: (2, "c", ["d"]), 1: (0, "e", [])}


def test_segmentation_keeps_every_sentence(spark):
    texts = [("t0", "d", "So we begin. Next it goes. Why? Yes it does. So we end."), ("t1", "e", None), ("t2", "d", "")]
    sents = pv.trace_sentences(spark.createDataFrame(texts, "trace_id string, dataset string, reasoning string"), "reasoning", "dataset")
    acc = spark.createDataFrame([("so we end",)], "ngram string")
    got = pv.segment(sents, acc, 3).orderBy("span_idx").collect()
    assert [(r.anchor, r.body_len, r.anchor_reason) for r in got] == [("So we begin.", 1, "structural"), ("Why?", 1, "structural"), ("So we end.", 0, "type_a")]
    assert [x for r in got for x in (r.anchor, *r.body)] == [r.sentence for r in sents.orderBy("i").collect()]


def test_latest_and_reason(spark):
    df = spark.createDataFrame([("a", 1, None, False), ("a", 2, True, False), ("b", None, None, True), (None, 1, True, None)], "trace_id string, loaded_at int, correct boolean, truncated boolean")
    got = {r.trace_id: r.correct for r in tr.latest(df, "correct").collect()}
    assert got == {"a": True, "b": None, None: True}
    why = df.withColumns({"model": F.lit("m"), "dataset": F.lit("x")}).withColumn("r", tr.corpus_reason([], []))
    assert {(r.trace_id, r.r) for r in why.collect()} == {("a", "unlabelled"), ("a", None), ("b", "truncated"), (None, None)}


def test_folds(spark):
    ids = [f"p{i}" for i in range(40)]
    for kind in ("stride", "split", "plain"):
        t = sampling.fold_table(ids, kind=kind)
        assert set(t) == set(ids) and set(t.values()) == set(range(5))
    df = spark.createDataFrame([(p,) for p in ids * 2], "problem_id string")
    assert sampling.with_fold(df, "problem_id").groupBy("problem_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_cosine(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(cosine(F.col("a"), F.col("b")).alias("c"), cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert r.c == pytest.approx(2**-0.5) and r.n is None


def _score_rows(spark, rule, n=400, problems=40):
    rnd = random.Random(6)
    rows = []
    for k in range(n):
        x = [max(rnd.gauss(0, 1), 0.0) for _ in range(6)]
        rows.append((f"t{k}", f"p{k % problems}", "ab"[k % 2], rule(x, k, rnd), x, ["good" if rule(x, k, rnd) else "bad", "word"]))
    return folded(spark.createDataFrame(rows, "k string, problem string, g string, y int, x array<double>, w array<string>"), "problem")


def _auc_of(scored):
    got = scored.where("score is not null").collect()
    return brute_auc([(r.y, r.score) for r in got]), len(got)


def test_scores_out_of_fold(spark):
    seen = _score_rows(spark, lambda x, k, rnd: int(x[0] + x[1] > 0.8))
    a, n = _auc_of(out_of_fold(seen, "k", "y", "x", rounds=60, carry=("y",)))
    assert a > 0.95 and n == 400
    a, _ = _auc_of(out_of_fold(seen, "k", "y", "x", kind="logistic", carry=("y",)))
    assert a > 0.9
    a, _ = _auc_of(out_of_fold(seen, "k", "y", "x", kind="ranker", problem="problem", carry=("y",)))
    assert a > 0.9
    # what only one's own row or problem could tell isn't known: labels by problem, features that say nothing
    noise = _score_rows(spark, lambda x, k, rnd: (k % 40) % 2)
    noise = noise.withColumn("x", F.array(F.substring("problem", 2, 3).cast("double"), F.pmod(F.hash("k"), F.lit(50)).cast("double")))
    a, _ = _auc_of(out_of_fold(noise, "k", "y", "x", rounds=60, carry=("y",)))
    assert a < 0.75


def test_scores_edges(spark):
    df = _score_rows(spark, lambda x, k, rnd: int(x[0] > 0.3))
    words = out_of_fold(df.withColumn("x", F.array(F.lit(0.0))), "k", "y", "x", tokens="w", rounds=20, carry=("y",))
    assert _auc_of(words)[0] > 0.95
    # groups are fitted by themselves; one with one class, or too few rows, has no scores, and nulls are scored but not fitted to
    mixed = df.withColumn("y", F.when(F.col("g") == "a", 1).when(F.col("k") == "t1", F.lit(None)).otherwise(F.col("y")))
    got = {(r.g, r.score is None) for r in out_of_fold(mixed, "k", "y", "x", group="g", rounds=5, carry=("g",)).collect()}
    assert got == {("a", True), ("b", False)}
    assert out_of_fold(mixed, "k", "y", "x", group="g", rounds=5, least=1000).where("score is not null").count() == 0
    assert out_of_fold(df.limit(0), "k", "y", "x", rounds=5).count() == 0
    many = out_of_fold(df.withColumn("c", F.concat(F.lit("c"), (F.col("x")[0] > 0.3).cast("int") + (F.col("x")[1] > 0.3).cast("int"))), "k", "c", "x", classes=["c0", "c1", "c2"], rounds=30, carry=("c",)).collect()
    hit = sum(r.c == f"c{max(range(3), key=r.probs.__getitem__)}" for r in many)
    assert hit > 0.9 * len(many) and all(abs(sum(r.probs) - 1) < 1e-9 for r in many)
    # a bounded sample is fitted to, all rows are scored
    assert _auc_of(out_of_fold(df, "k", "y", "x", rounds=30, most=150, carry=("y",)))[1] == 400


def test_early_fits_take_all_rows(spark):
    """F1 (early_summary): a fit's words and features are of all rows of the other folds, whatever a task takes up at a time."""
    df = _score_rows(spark, lambda x, k, rnd: int(x[0] + x[1] > 0.8 and rnd.random() < 0.9)).withColumn("w", F.concat("w", F.array(F.concat(F.lit("of"), F.substring("k", 2, 2)))))
    scores = lambda most: {r.k: r.score for r in out_of_fold(df, "k", "y", "x", group="g", tokens="w", rounds=15, most=most).collect()}
    whole = scores(20_000)
    assert len(whole) == 400 and None not in whole.values()
    assert scores(30) == whole


def test_class_fits_take_all_rows(spark):
    """F2 (model_class_scores): fits of many classes are of all rows of the other folds, whatever a task takes up at a time."""
    df = _score_rows(spark, lambda x, k, rnd: 0, n=240).withColumn("c", F.when(F.col("x")[0] > F.col("x")[1], "a").when(F.col("x")[2] > 0.4, "b").otherwise("c"))
    probs = lambda most: {r.k: r.probs for r in out_of_fold(df, "k", "c", "x", classes=["a", "b", "c"], rounds=15, most=most).collect()}
    whole = probs(20_000)
    assert len(whole) == 240 and all(whole.values())
    assert probs(20) == whole


def test_all_models_are_classes(spark, monkeypatch):
    """F3 (model_identification): every model that a trace has is a class, and every row is handed to the fits."""
    rows = spark.range(1003).select(F.col("id").cast("string").alias("trace_id"), F.format_string("m%04d", "id").alias("model"), F.lit(0).alias("fold"), F.array(F.lit(1.0)).alias("x"))
    monkeypatch.setattr(learned, "_operators", lambda *a, **k: rows)
    given = []

    def fits(df, key, label, x, *, classes, **options):
        given.append((df.count(), classes, options))
        return df.select(key, "model", F.array(F.lit(1.0)).alias("probs"))

    monkeypatch.setattr(learned.fo, "out_of_fold", fits)
    learned.model_identification(spark, "")
    assert given[0][0] == 1003 and given[0][1] == [f"m{i:04d}" for i in range(1003)] and "most" not in given[0][2]


def test_trees_of_many_codes(spark):
    """with more codes than two bytes number, and in blocks of a thousand rows, the trees are those of numpy."""
    rng = np.random.default_rng(8)
    for x, k in ((rng.random((60, 4600)), 3), (rng.random((2500, 5)), 2)):
        x = x.astype(np.float32)
        y = ((x[:, 0] + x[:, 1]) * k / 2.1).astype(int).clip(0, k - 1)
        plain, other = Boosted(rounds=3, depth=3).fit(x, y, k), Boosted(rounds=3, depth=3)
        packed = other.packed(boosting.Sparse.of(x), y, k)
        other.taken(bytes(spark.createDataFrame([(bytearray(packed),)], "b binary").select(grown(spark, F.col("b"))).first()[0]))
        assert (len(other.cuts.feature) > 1 << 16) == (k == 3)
        assert all((a == b).all() for a, b in zip(plain.splits, other.splits)) and np.abs(np.array(plain.leaves) - other.leaves).max() < 1e-12


def test_gathered_rows_are_those_at_once():
    rng = np.random.default_rng(5)
    x = np.where(rng.random((90, 7)) < 0.4, rng.random((90, 7)) - 0.2, 0).astype(np.float32)
    texts = pa.array([[f"w{v}" for v in rng.integers(0, 30, rng.integers(0, 9))] for _ in range(90)], pa.list_(pa.string()))
    plain, words, parts = boosting.Words(texts), boosting.Gathered(True), boosting.Gathered(above=False)
    for i in range(0, 90, 25):
        words.add(x[i : i + 25], texts.slice(i, 25))
        parts.add(x[i : i + 25])
    got, known = words.done()
    assert known.place == plain.place and np.allclose(known.idf, plain.idf)
    dense = np.zeros(got.shape, np.float32)
    dense[got.row, got.col] = got.value
    assert np.allclose(dense, np.c_[plain.weights(texts), np.maximum(x, 0)])
    got, _ = parts.done()
    assert len(got.row) == (x != 0).sum() and (got.value == x[got.row, got.col]).all()


def test_fold_kinds(spark):
    df = spark.createDataFrame([(f"p{k % 23}", "ab"[k % 2]) for k in range(92)] + [(None, "a")], "problem string, g string")
    for by in ("hash", "stride", "split", "plain"):
        got = folded(df, "problem", by=by)
        assert got.count() == 93 and got.groupBy("problem").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    per = folded(df, "problem", group="g")
    assert per.count() == 93 and {(r.g, r.n) for r in per.groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()} == {("a", 5), ("b", 5)}


def test_random_kappa(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    true = rnd.choice(4, 600, p=[0.5, 0.3, 0.1, 0.1])
    kappas = []
    for _ in range(300):
        pred = rnd.integers(0, 4, 600)
        po, pe = (true == pred).mean(), sum((true == c).mean() * (pred == c).mean() for c in range(4))
        kappas.append((po - pe) / (1 - pe))
    got = m.random_kappa(spark.createDataFrame([(int(t),) for t in true] + [(None,)], "t int"), "t", 4, 1000).first()
    assert abs(got["mean"] - np.mean(kappas)) < 0.004 and abs(got.deviation / np.std(kappas) - 1) < 0.2 and got.trials == 1000


def test_ranks_and_pairs(spark):
    from spanloom.operators.vectors import hashed_pairs

    df = spark.range(500).select(F.col("id").cast("string").alias("k")).withColumn("h", F.md5("k"))
    got = [r.k for r in m.ranked_by(df, "h", "k", 2).orderBy("rank").collect()]
    assert got == [r.k for r in df.orderBy("h", "k").collect()] and m.ranked_by(df, "h", "k").agg(F.max("rank")).first()[0] == 499
    e = spark.range(60).select("id", (F.col("id") % 10 == 0).cast("int").alias("g"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    pairs = hashed_pairs(e, "id", "g", "v", 25).collect()
    assert len(pairs) == 25 and all(r.g != r.g2 for r in pairs)


def test_clusters(spark):
    from spanloom.operators import learning as ml

    rnd = random.Random(8)
    rows = [(f"r{k}", [rnd.gauss(10 * (k % 3), 0.2), rnd.gauss(5 * (k % 2), 0.2)]) for k in range(120)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, x array<double>")
    got, cost = ml.cluster(df, "k", "x", 6, restarts=10)
    of = {r.k: r.cluster for r in got.collect()}
    assert len({of[f"r{k}"] for k in range(6)}) == 6 and all(of[f"r{k}"] == of[f"r{k % 6}"] for k in range(120)) and of["none"] is None and cost < 20
    sweep = {r.k: (r.cost, r.silhouette) for r in ml.cluster_sweep(df, "k", "x", [2, 3, 6, 7], restarts=8).collect()}
    assert sweep[2][0] > sweep[3][0] > sweep[6][0] > sweep[7][0] and max(sweep, key=lambda k: sweep[k][1]) == 6
    assert ml.cluster_sweep(df.limit(0), "k", "x", [2]).count() == 0

    class Lengths:
        def embed(self, texts):
            return [[len(t), 1.0] for t in texts]

    assert {r.k: r.x for r in ml.embed(df.select("k", F.when(F.col("k") != "none", F.col("k")).alias("t")).limit(200), "k", "t", Lengths, batch=7).collect() if r.k in ("r1", "none")} == {"r1": [2.0, 1.0], "none": None}


def test_early_scores_at_every_depth(spark):
    from spanloom.plans.learned import early_scores

    assert {r.depth for r in early_scores(spark, "/root/testdata/sf0.001").select("depth").distinct().collect()} == {10, 25, 50, 75, 100}


def _plain_trees(x, y, classes, rounds, depth, coarse, seed=42):
    """Every cut of every node summed anew: the first of the best by place, then features, those with more cuts first."""
    rng, outs = np.random.default_rng(seed), 1 if classes == 2 else classes
    cuts = []
    for f in range(x.shape[1]):
        seen, bins = np.unique(x[:, f][x[:, f] > 0]), 16 if f >= coarse else 4
        cuts.append(seen if len(seen) <= bins else np.unique(np.quantile(seen, np.arange(bins) / bins, method="lower")))
    tried = sorted(((b, -len(c), f) for f, c in enumerate(cuts) for b in range(len(c))))
    score, target = np.zeros((len(x), outs)), (y[:, None] == (np.arange(classes) if outs > 1 else 1)).astype(float)
    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(1, keepdims=True) if outs > 1 else 1 / (1 + np.exp(-score))
        drawn, open_ = rng.random(len(x)) < 0.8, rng.random(x.shape[1]) < 0.8
        for k in range(outs):
            g, h = np.where(drawn, p[:, k] - target[:, k], 0), np.where(drawn, p[:, k] * (1 - p[:, k]), 0)

            def grow(at, left):
                whole, best = (g[at].sum(), h[at].sum()), (1e-9, None)
                for b, _, f in tried if left else ():
                    right = x[at, f] >= cuts[f][b]
                    a, w = g[at][right].sum(), h[at][right].sum()
                    gain = (whole[0] - a) ** 2 / (whole[1] - w + 1) + a**2 / (w + 1) - whole[0] ** 2 / (whole[1] + 1)
                    if open_[f] and w >= 1 and whole[1] - w >= 1 and gain > best[0] + 1e-8:
                        best = (gain, right)
                if best[1] is None:
                    score[at, k] -= 0.05 * whole[0] / (whole[1] + 1)
                else:
                    grow(at[~best[1]], left - 1)
                    grow(at[best[1]], left - 1)

            grow(np.arange(len(x)), depth)
    p = 1 / (1 + np.exp(-score[:, 0])) if outs == 1 else None
    return np.exp(score) / np.exp(score).sum(1, keepdims=True) if outs > 1 else np.stack([1 - p, p], 1)


def test_boosted_as_plain_search():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((300, 9)) < 0.6, rng.random((300, 9)), 0).astype(np.float32)
    x[:, 8] = (np.arange(300) < 3) * 0.5  # too rare to be cut
    for k in (2, 3):
        y = ((x[:, 0] + x[:, 1] + 0.3 * rng.random(300)) * k / 2.4).astype(int).clip(0, k - 1)
        got = Boosted(rounds=5, depth=4).fit(x, y, k, 4).predict(x)
        assert np.abs(got - _plain_trees(x, y, k, 5, 4, 4)).max() < 1e-8


def test_boosted_sums_fewer_rows():
    """Of two children one is summed, so what is summed below the root is at most half of the rows a level."""
    rng = np.random.default_rng(2)
    x, summed = rng.random((400, 5)).astype(np.float32), []
    sums = boosting._Entries.sums

    def counted(self, slot, part, *rest):
        summed.append((slot[part] >= 0).sum() / len(part))
        return sums(self, slot, part, *rest)

    boosting._Entries.sums = counted
    try:
        Boosted(rounds=5).fit(x, (x[:, 0] + x[:, 1] > 1).astype(int))
    finally:
        boosting._Entries.sums = sums
    assert summed and max(summed) <= 0.5
    assert Boosted(rounds=2).fit(np.zeros((4, 2), np.float32), np.array([0, 1, 0, 1])).predict(np.ones((1, 2), np.float32)).shape == (1, 2)


def test_trees_of_the_jvm_are_those_of_numpy(spark):
    """F2, F3: fits run in the executors' JVM; the same splits, leaves and scores, of dense and of sparse samples."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((400, 12)) < 0.5, rng.random((400, 12)), 0).astype(np.float32)
    for k in (2, 3):
        y = ((x[:, 0] + x[:, 1] + 0.5 * rng.random(400)) * k / 2.4).astype(int).clip(0, k - 1)
        plain, other = Boosted(rounds=20).fit(x, y, k, 4), Boosted(rounds=20)
        packed = other.packed(boosting.Sparse.of(x), y, k, 4)
        trees = spark.createDataFrame([(bytearray(packed),)], "b binary").select(grown(spark, F.col("b"))).first()[0]
        other.taken(bytes(trees))
        assert all((a == b).all() for a, b in zip(plain.splits, other.splits)) and len(plain.splits) == len(other.splits)
        assert np.abs(plain.predict(x) - Boosted.of(**other.state()).predict(boosting.Sparse.of(x), chunk=64)).max() < 1e-9


def test_features_in_one_pass_are_those_of_sql(spark):
    seqs = [[0, 0, 1, 2, 2, 2, 0], [3], [-1, None], [], None, [1, -1, 1, None, 9, 1], [2, 1] * 9]
    df = spark.createDataFrame([(str(i), q) for i, q in enumerate(seqs)], "trace_id string, operator_sequence array<int>")
    ops = [0, 1, 2, 3]
    old = {r.trace_id: r.x for r in s.vectors(s.features(s.entries(df)), s.feature_names(ops)).collect()}
    new = {r.trace_id: r.x for r in s.with_features(df, ops).collect()}
    assert old.keys() == new.keys() == {"0", "1", "5", "6"}
    assert all(np.allclose(old[k], new[k], atol=1e-6) for k in old)


def test_class_scores_score_once(spark):
    """the counts are read twice, what they are counted from is scored once."""
    df = learned.model_class_scores(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and df.count() > 0
