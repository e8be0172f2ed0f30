"""Sentence openers: vocabulary, frequent openers (pivots), spans that begin at them, their labels and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import alpha_tokens, full_text, opener, sentence_list, structural

BODY_MOST = 50


def trace_sentences(traces: DataFrame, text: str, *keep: str) -> DataFrame:
    """(trace_id, ..., i, sentence), one row per sentence; traces without any are left out."""
    return traces.select("trace_id", *keep, F.posexplode(sentence_list(F.col(text))).alias("i", "sentence"))


def vocabulary(sentences: DataFrame, size: int) -> DataFrame:
    """(token, n): the most frequent tokens, ties by token. Only ``size`` rows of each task reach the last step."""
    tokens = sentences.select(F.explode(alpha_tokens(F.col("sentence"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size)


def opener_stats(sentences: DataFrame, n_tokens: int) -> DataFrame:
    """(ngram, freq, traces, datasets) of every opener.

    Counted first by opener, dataset and trace, so that a frequent opener is spread over its traces before it is gathered.
    """
    starts = sentences.select("trace_id", "dataset", opener(F.col("sentence"), n_tokens).alias("ngram")).where(F.col("ngram") != "")
    each = starts.groupBy("ngram", "trace_id", "dataset").agg(F.count("*").alias("n"))
    by_trace = each.groupBy("ngram", "trace_id").agg(F.sum("n").alias("n"))
    per_set = each.groupBy("ngram", "dataset").agg(F.lit(1).alias("one")).groupBy("ngram").agg(F.count_if(F.col("dataset").isNotNull()).alias("datasets"))
    return by_trace.groupBy("ngram").agg(F.sum("n").alias("freq"), F.count("*").alias("traces")).join(per_set, "ngram")


def pivots(stats: DataFrame, vocab: DataFrame, *, top: int = 50_000, min_traces: int = 100, min_datasets: int = 3) -> DataFrame:
    """The accepted openers. The cut to the ``top`` most frequent comes before the other conditions; every token must be in the vocabulary."""
    first = stats.orderBy(F.desc("freq"), "ngram").limit(top)
    fit = first.where((F.col("traces") >= min_traces) & (F.col("datasets") >= min_datasets))
    tokens = fit.select("ngram", F.explode(F.split("ngram", " ")).alias("token"))
    known = tokens.join(vocab.select("token", F.lit(True).alias("in_vocab")), "token", "left")
    good = known.groupBy("ngram").agg(F.bool_and(F.coalesce("in_vocab", F.lit(False))).alias("all_in")).where("all_in")
    return fit.join(good.select("ngram"), "ngram", "left_semi")


def segment(sentences: DataFrame, accepted: DataFrame, n_tokens: int) -> DataFrame:
    """(trace_id, span_idx, anchor, body, body_len, anchor_reason, ngram) of the spans of every trace.

    A span begins at each structural sentence and at each whose opener is accepted. Its body holds at most 50 sentences,
    ``body_len`` counts them all.
    """
    order = Window.partitionBy("trace_id").orderBy("i")
    s = sentences.withColumn("ngram", opener(F.col("sentence"), n_tokens))
    s = s.join(accepted.select("ngram", F.lit(True).alias("hit")), "ngram", "left")
    form = structural(F.col("sentence"), F.lag("sentence").over(order), F.col("i"))
    s = s.withColumn("begins", F.coalesce("hit", F.lit(False)) | form)
    s = s.withColumn("span_idx", (F.sum(F.col("begins").cast("int")).over(order) - 1).cast("int"))
    head = F.min_by(F.struct("sentence", "ngram", F.coalesce("hit", F.lit(False)).alias("hit")), "i")
    body = F.transform(F.slice(F.sort_array(F.collect_list(F.when(~F.col("begins"), F.struct("i", "sentence")))), 1, BODY_MOST), lambda x: x["sentence"])
    spans = s.groupBy("trace_id", "span_idx").agg(head.alias("h"), body.alias("body"), F.count_if(~F.col("begins")).cast("int").alias("body_len"))
    return spans.select(
        "trace_id", "span_idx", F.col("h.sentence").alias("anchor"), "body", "body_len",
        F.when(F.col("h.hit"), "type_a").otherwise("structural").alias("anchor_reason"), F.col("h.ngram").alias("ngram"),
    )


def label_spans(spans: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster`` by exact opener, -1 where none is known."""
    return spans.drop("cluster").join(clusters.select("ngram", "cluster"), "ngram", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def one_span(spans: DataFrame, *columns: str) -> DataFrame:
    """Each (trace_id, span_idx) once."""
    best = spans.groupBy("trace_id", "span_idx").agg(F.max(F.struct(*columns)).alias("_v"))
    return best.select("trace_id", "span_idx", *[F.col(f"_v.{c}").alias(c) for c in columns])


def fold(spans: DataFrame) -> DataFrame:
    """(trace_id, op_idx, cluster, anchor, continuation): spans with a cluster, each with the texts of those without that follow.

    ``op_idx`` -1 is what comes before the first: the preamble, without cluster and anchor.
    """
    order = Window.partitionBy("trace_id").orderBy("span_idx")
    s = spans.withColumn("opens", F.coalesce(F.col("cluster") >= 0, F.lit(False)))
    s = s.withColumn("op_idx", (F.sum(F.col("opens").cast("int")).over(order) - 1).cast("int"))
    said = F.when(~F.col("opens"), F.struct("span_idx", full_text(F.col("anchor"), F.col("body")).alias("t")))
    return s.groupBy("trace_id", "op_idx").agg(
        F.max(F.when(F.col("opens"), F.col("cluster"))).alias("cluster"),
        F.max(F.when(F.col("opens"), F.col("anchor"))).alias("anchor"),
        F.transform(F.sort_array(F.collect_list(said)), lambda x: x["t"]).alias("continuation"),
    )


def assembled(traces: DataFrame, folded: DataFrame, names: DataFrame) -> DataFrame:
    """Traces with their preamble, spans and operator sequence as arrays; empty where a trace has no spans."""
    named = folded.join(names.groupBy("cluster").agg(F.min("name").alias("operator")), "cluster", "left")
    spans = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("op_idx") >= 0, F.struct("op_idx", "operator", "cluster", "anchor", "continuation")))),
        lambda x: F.struct(x["operator"].alias("operator"), x["cluster"].alias("cluster"), x["anchor"].alias("anchor"), x["continuation"].alias("continuation")),
    )
    per = named.groupBy("trace_id").agg(spans.alias("spans"), F.max(F.when(F.col("op_idx") < 0, F.col("continuation"))).alias("preamble"))
    out = traces.drop("spans", "preamble", "operator_sequence").join(per, "trace_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"preamble": F.coalesce("preamble", none), "operator_sequence": F.coalesce(F.col("spans.cluster"), F.array().cast("array<int>"))})


def normalised_entropy(counts: DataFrame, keys: list[str], n: str, classes: Column) -> DataFrame:
    """(keys, entropy): -sum p ln p over ln(classes), to three digits; 0 without counts or under two classes."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    h = counts.join(total, keys).where(F.col(n) > 0).groupBy(*keys).agg(F.sum(-p * F.log(p)).alias("_h"))
    return h.select(*keys, F.round(F.when(classes < 2, F.lit(0.0)).otherwise(F.col("_h") / F.log(classes)), 3).alias("entropy"))


def cluster_stats(spans: DataFrame) -> DataFrame:
    """(cluster, spans, datasets, entropy) of every labelled cluster; entropy over all datasets seen."""
    by = spans.where(F.col("cluster") >= 0).groupBy("cluster", "dataset").agg(F.count("*").alias("n"))
    classes = spans.where("dataset is not null").agg(F.count_distinct("dataset").alias("k")).scalar()
    h = normalised_entropy(by, ["cluster"], "n", classes.cast("double"))
    return by.groupBy("cluster").agg(F.sum("n").alias("spans"), F.count("dataset").alias("datasets")).join(h, "cluster")


def top_per_group(counts: DataFrame, group: str, item: str, n: str, k: int) -> DataFrame:
    """The ``k`` greatest of each group, ties by item; ranks are cut off in each task before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(n), item)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exemplars(spans: DataFrame, k: int) -> DataFrame:
    """The first ``k`` spans of each cluster in the order of traces."""
    order = Window.partitionBy("cluster").orderBy("trace_id", "span_idx")
    return spans.where(F.col("cluster") >= 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
