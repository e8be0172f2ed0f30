"""Grouped metrics: AUC within groups, agreement, confusion, class scores, resampling.

Labels are 0 and 1; null labels and scores are left out. Nothing gathers the rows of a group in one task: ranks come from
counts by distinct score, and in a group they are summed over ranges of scores first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, groups: list[str], label: Column, score: Column, *, ranges: int = 64) -> DataFrame:
    """(groups, auc, pos, neg): the share of pairs of a 1 and a 0 in the right order, ties by half; null with one class only."""
    rows = df.select(*groups, label.cast("int").alias("_y"), score.cast("double").alias("_s")).where("_y is not null and _s is not null")
    by = rows.groupBy(*groups, "_s").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q"))
    # the bounds of the ranges: one row of ``ranges`` numbers
    cuts = by.agg(F.percentile_approx("_s", [k / ranges for k in range(1, ranges)], 1000).alias("_c")).withColumn("_one", F.lit(1))
    ranged = by.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one").withColumn("_r", F.size(F.filter("_c", lambda c: c < F.col("_s")))).drop("_one", "_c")
    part = ranged.groupBy(*groups, "_r").agg(F.sum("_q").alias("_rq"))
    before = part.withColumn("_base", F.sum("_rq").over(Window.partitionBy(*groups).orderBy("_r")) - F.col("_rq")).drop("_rq")
    inner = Window.partitionBy(*groups, "_r").orderBy("_s")
    joined = _join_null_safe(ranged, before, [*groups, "_r"])
    u2 = F.col("_p") * (2 * (F.col("_base") + F.col("_below")) + F.col("_q"))
    return (
        joined.withColumn("_below", F.sum("_q").over(inner) - F.col("_q"))
        .groupBy(*groups)
        .agg(F.sum(u2).alias("_u2"), F.sum("_p").alias("pos"), F.sum("_q").alias("neg"))
        .select(*groups, F.try_divide(F.col("_u2"), 2.0 * F.col("pos") * F.col("neg")).alias("auc"), "pos", "neg")
    )


def _join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = b.select(*[F.col(k).alias(f"_j_{k}") if k in keys else F.col(k) for k in b.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(renamed, cond, how).drop(*[f"_j_{k}" for k in keys])


def within_auc(df: DataFrame, outer: list[str], inner: list[str], label: Column, score: Column) -> DataFrame:
    """(outer, wp_auc, n_groups): the mean AUC of the inner groups that have both labels; null without any."""
    each = auc(df, [*outer, *inner], label, score).where(F.col("auc").isNotNull())
    return each.groupBy(*outer).agg(F.avg("auc").alias("wp_auc"), F.count("*").alias("n_groups"))


def fold_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, deviation, folds) over folds, the deviation that of the folds themselves; null values are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("deviation"), F.count(value).alias("folds"))


def scores_long(df: DataFrame, ids: list[str], scores: list[str]) -> DataFrame:
    return df.unpivot(ids, scores, "method", "score")


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_shares(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(true, pred, share) for all pairs of labels, of each row's total; rows without any count are zero."""
    names = labels.agg(F.collect_set("label")).scalar()  # a row for each label and every label beside it
    total = counts.groupBy("true").agg(F.sum("n").alias("t"))
    grid = labels.select(F.col("label").alias("true"), F.explode(names).alias("pred"))
    dense = grid.join(total, "true", "left").join(counts, ["true", "pred"], "left")
    return dense.select("true", "pred", F.coalesce(F.col("n") / F.col("t"), F.lit(0.0)).alias("share"))


def kappa(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, n, agreement, kappa) from (groups, true, pred, n); over the union of labels."""
    g = list(groups)
    rows = counts.groupBy(*g, F.col("true").alias("label")).agg(F.sum("n").alias("a"))
    cols = counts.groupBy(*g, F.col("pred").alias("label")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, [*g, "label"]).groupBy(*g).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    whole = counts.groupBy(*g).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    both = whole.join(chance, g, "left") if g else whole.withColumn("_k", F.lit(1)).join(chance.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    po = F.col("hit") / F.col("n")
    pe = F.coalesce(F.col("ab"), F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*g, "n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def class_scores(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each label; 0 where a quotient has nothing below."""
    t = counts.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"))
    p = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("chosen"))
    h = counts.where(F.col("true") == F.col("pred")).select(F.col("true").alias("label"), F.col("n").alias("hit"))
    all_ = t.join(p, "label", "full").join(h, "label", "left").fillna(0, ["support", "chosen", "hit"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return all_.select(
        "label", ratio(F.col("hit"), F.col("chosen")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2.0 * F.col("hit"), F.col("chosen") + F.col("support")).alias("f1"), "support",
    )


def one_vs_rest(probs: DataFrame, true: str, cls: str, prob: str) -> DataFrame:
    """(class, auc) from one row for each case and class; classes that are all or none of the cases are left out."""
    return auc(probs, [cls], F.col(true) == F.col(cls), F.col(prob)).where(F.col("auc").isNotNull())


def md5_int(*parts: Column) -> Column:
    """A whole number from the MD5 of parts joined by colons, alike in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def random_kappa(df: DataFrame, true: str, labels: int, trials: int, seed: int = 42) -> DataFrame:
    """(mean, deviation, trials) of kappa against labels 0 to ``labels`` - 1 drawn at random: what chance gives.

    Only how many cases of a class get each label counts, so these numbers are drawn, from the multinomial of the class's
    cases: trials x labels squared rows, however many cases. Null labels are left out.
    """
    counts = df.where(F.col(true).isNotNull()).groupBy(F.col(true).cast("int").alias("true")).agg(F.count("*").alias("n"))
    each = counts.select("true", "n", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))

    def draw(parts):
        for part in parts:
            rows = [(t, k, i, int(c)) for t, n, k in zip(part["true"], part["n"], part["trial"]) for i, c in enumerate(np.random.default_rng([seed, int(k), int(t) + 2**31]).multinomial(int(n), [1 / labels] * labels)) if c]
            yield pd.DataFrame(rows, columns=["true", "trial", "pred", "n"])

    per = kappa(each.mapInPandas(draw, "true int, trial int, pred int, n long"), ["trial"])
    return per.agg(F.avg("kappa").alias("mean"), F.stddev_pop("kappa").alias("deviation"), F.count("*").alias("trials"))


def ranked_by(df: DataFrame, h: str, key: str, digits: int = 3) -> DataFrame:
    """Rows with ``rank`` from 0 in the order of a hexadecimal hash and key: numbered within ranges of hashes that are alike in
    their first digits, after the counts of the ranges before; no task orders all rows."""
    part = df.withColumn("_r", F.left(h, F.lit(digits)))
    ranges = part.groupBy("_r").agg(F.count("*").alias("_n"))
    before = ranges.select(F.col("_r").alias("_s"), (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))  # 16 ** digits rows
    inner = F.row_number().over(Window.partitionBy("_r").orderBy(h, key))
    return part.join(F.broadcast(before), F.col("_r") == F.col("_s")).withColumn("rank", F.col("_b") + inner - 1).drop("_r", "_s", "_b")


def bootstrap(values: DataFrame, value: str, key: str, resamples: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(mean, low, high) of the mean of values drawn with replacement as often as there are values.

    The j-th draw of a resample is the value whose rank is the hash of resample and j. ``values`` is a table of groups, a
    row each, not of cases; each resample's draws are counted by rank, so that the join moves ranks, not cases.
    """
    ranked = ranked_by(values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.md5(F.col(key)).alias("h"), F.col(key).alias("k")), "h", "k").select("v", "rank")
    n = values.agg(F.count(value)).scalar()
    draws = ranked.select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"), F.col("rank").alias("j")).select(
        "b", F.pmod(md5_int(F.col("b"), F.col("j")), n).cast("int").alias("rank")
    )
    means = draws.groupBy("b", "rank").agg(F.count("*").alias("c")).join(ranked, "rank").groupBy("b").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m"))
    bounds = means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))
    return ranked.agg(F.avg("v").alias("mean")).withColumn("_k", F.lit(1)).join(bounds.withColumn("_k", F.lit(1)), "_k").drop("_k")


def rank_biserial(df: DataFrame, first: Column, score: Column) -> DataFrame:
    """(r, z, p): effect of group ``first`` against the other, with the normal approximation corrected for ties."""
    rows = df.select(first.cast("int").alias("y"), score.alias("s")).where("y is not null and s is not null")
    a = auc(rows, [], F.col("y"), F.col("s"))
    ties = rows.groupBy("s").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    both = a.withColumn("_k", F.lit(1)).join(ties.withColumn("_k", F.lit(1)), "_k")
    n1, n2 = F.col("pos").cast("double"), F.col("neg").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.col("auc") - 0.5) * n1 * n2 / sd
    t = 1 / (1 + 0.3275911 * F.abs(z) / F.sqrt(F.lit(2.0)))
    erfc = (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z / 2)
    return both.select((2 * F.col("auc") - 1).alias("r"), z.alias("z"), erfc.alias("p"))
