"""Tables of reports: rates by group, operator profiles, contrasts, dataset comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def rates(df: DataFrame) -> DataFrame:
    """(by, name, total, correct, rate) for each dataset, each model and all, in one pass over the rows."""
    g = df.groupingSets([["dataset"], ["model"], []], "dataset", "model").agg(
        F.grouping_id("dataset", "model").alias("gid"), F.count("*").alias("total"), F.sum(F.when(F.col("correct"), 1).otherwise(0)).alias("correct")
    )
    by = F.when(F.col("gid") == 1, "dataset").when(F.col("gid") == 2, "model").otherwise("all")
    name = F.when(F.col("gid") == 1, F.col("dataset")).when(F.col("gid") == 2, F.col("model"))
    return g.select(by.alias("by"), name.alias("name"), "total", "correct", F.try_divide(F.col("correct"), F.col("total")).alias("rate"))


def graded_counts(df: DataFrame, group: str, result: str) -> DataFrame:
    """(group, total, yes, no, unclear, share) of a result that is true, false or null."""
    r = F.col(result)
    out = df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(r).alias("yes"), F.count_if(~r).alias("no"), F.count_if(r.isNull()).alias("unclear"))
    return out.withColumn("share", F.col("yes") / F.greatest(F.col("total") - F.col("unclear"), F.lit(1)))


def _dense(ev: DataFrame, keep: list[str], ops: list[int]) -> DataFrame:
    """(trace_id, keep, op, f): the share of every operator in each trace, zeros included."""
    per = ev.groupBy("trace_id", *keep, "n").agg(F.map_from_entries(F.collect_list(F.struct("op", "c"))).alias("m")) if "c" in ev.columns else None
    if per is None:
        counts = ev.groupBy("trace_id", *keep, "n", "op").agg(F.count("*").alias("c"))
        per = counts.groupBy("trace_id", *keep, "n").agg(F.map_from_entries(F.collect_list(F.struct("op", "c"))).alias("m"))
    out = per.select("trace_id", *keep, "n", "m", F.explode(F.array(*[F.lit(o) for o in ops])).alias("op"))
    return out.select("trace_id", *keep, "op", (F.coalesce(F.try_element_at("m", F.col("op")), F.lit(0)) / F.col("n")).alias("f"))


def operator_profiles(ev: DataFrame, ops: list[int]) -> DataFrame:
    """(model, op, mean, z): mean share of each operator in a model's traces, and its distance from that of all traces in
    standard deviations of traces."""
    f = _dense(ev, ["model"], ops)
    whole = f.groupBy("op").agg(F.avg("f").alias("m"), F.stddev_pop("f").alias("s"))
    per = f.groupBy("model", "op").agg(F.avg("f").alias("mean"))
    return per.join(whole, "op").select("model", "op", "mean", ((F.col("mean") - F.col("m")) / F.greatest(F.col("s"), F.lit(1e-8))).alias("z"))


def extreme_operators(profiles: DataFrame) -> DataFrame:
    """(model, most, least): the operators that stand out, ties by the lower."""
    return profiles.groupBy("model").agg(F.max_by("op", F.struct("z", -F.col("op"))).alias("most"), F.min_by("op", F.struct("z", "op")).alias("least"))


def group_contrast(profiles: DataFrame, best: list[str], worst: list[str]) -> DataFrame:
    """(op, best, worst, delta): means of the models' means of two groups."""
    m = F.col("model")
    out = profiles.groupBy("op").agg(F.avg(F.when(m.isin(best), F.col("mean"))).alias("best"), F.avg(F.when(m.isin(worst), F.col("mean"))).alias("worst"))
    return out.withColumn("delta", F.col("best") - F.col("worst"))


def correctness_heatmap(ev: DataFrame, ops: list[int]) -> DataFrame:
    """(dataset, correct, op, percent): mean share of each operator, in percent."""
    return _dense(ev, ["dataset", "correct"], ops).groupBy("dataset", "correct", "op").agg((F.avg("f") * 100).alias("percent"))


def dataset_comparison(traces: DataFrame, length: Column) -> DataFrame:
    """(dataset, n, rate, median_length, problems, per_problem)."""
    out = traces.groupBy("dataset").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("rate"), F.median(length).alias("median_length"), F.count_distinct("problem_id").alias("problems")
    )
    return out.withColumn("per_problem", F.col("n") / F.col("problems"))


def transition_shares(ev: DataFrame) -> DataFrame:
    """(op, nxt, n, share): pairs of neighbours over all traces, of all that follow an operator."""
    from pyspark.sql import Window

    order = Window.partitionBy("trace_id").orderBy("pos")
    pairs = ev.withColumn("nxt", F.lead("op").over(order)).where(F.col("nxt").isNotNull()).groupBy("op", "nxt").agg(F.count("*").alias("n"))
    return pairs.join(pairs.groupBy("op").agg(F.sum("n").alias("t")), "op").select("op", "nxt", "n", (F.col("n") / F.col("t")).alias("share"))


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """(class, n, percent) over the rows that have a class."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column)).scalar()
    return counts.select("class", "n", (F.col("n") * 100.0 / total).alias("percent"))


def alignment(counts: DataFrame, k: int = 2) -> DataFrame:
    """(true, pred, n, share, rank): of each true class the ``k`` classes that it goes with most, ties by class."""
    from pyspark.sql import Window

    total = counts.groupBy("true").agg(F.sum("n").alias("t"))
    ranked = counts.join(total, "true").withColumn("rank", F.row_number().over(Window.partitionBy("true").orderBy(F.desc("n"), "pred")))
    return ranked.where(F.col("rank") <= k).select("true", "pred", "n", (F.col("n") / F.col("t")).alias("share"), "rank")


def best_by(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(group, best, score): the item with the greatest score of each group, ties by the lesser item."""
    ranked = df.groupBy(group).agg(F.max(score).alias("_m")).join(df.select(F.col(group).alias("_g"), item, score), F.col(group) == F.col("_g"))
    return ranked.where(F.col(score) == F.col("_m")).groupBy(group).agg(F.min(item).alias("best"), F.max("_m").alias("score"))
