"""Selections and keys of trace tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, *columns: str, key: str = "trace_id", by: tuple[str, ...] = ("loaded_at", "correct")) -> DataFrame:
    """The last delivery of each key, by the columns ``by`` in turn, null before any value. Only the columns named are moved.

    Deliveries are combined in each task first: a key with many of them costs one row per task. Null is a key.
    """
    kept = [c for c in (columns or df.columns) if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*by)).alias("_v"))
    return last.select(key, *[F.col(f"_v.{c}").alias(c) for c in kept])


def skip_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null where none does."""
    return reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))


def corpus_reason(drop_models: list[str], drop_datasets: list[str]) -> Column:
    """Why a trace is left out of the labelled corpus: its model, its dataset, a cut, a missing label; null if it is kept."""
    return skip_reason(
        [
            ("model", F.col("model").isin(drop_models)),
            ("dataset", F.col("dataset").isin(drop_datasets)),
            ("truncated", F.coalesce(F.col("truncated"), F.lit(False))),
            ("unlabelled", F.col("correct").isNull()),
        ]
    )


def labelled(df: DataFrame, drop_datasets: list[str] = (), need_sequence: bool = False) -> DataFrame:
    kept = df.where(F.col("correct").isNotNull())
    if drop_datasets:
        kept = kept.where(~F.col("dataset").isin(list(drop_datasets)))
    return kept.where(F.size("operator_sequence") > 0) if need_sequence else kept


def trace_key() -> Column:
    """The id where there is one, else model, dataset, problem and sample joined."""
    return F.coalesce(
        F.nullif(F.col("trace_id"), F.lit("")), F.concat_ws("__", "model", "dataset", "problem_id", F.concat(F.lit("s"), F.col("sample").cast("string")))
    )


def not_done(candidates: DataFrame, done: DataFrame, key: str = "trace_id") -> DataFrame:
    """The candidates whose key isn't done yet."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def candidates(df: DataFrame, done: DataFrame, *, skip: list[str] = (), dataset: str | None = None, limit: int | None = None, key: str = "trace_id") -> DataFrame:
    """What is left to grade: not truncated, of no dataset to skip, not done; of one dataset only, and the first by key, if asked."""
    kept = df.where(~F.coalesce("truncated", F.lit(False)))
    if skip:
        kept = kept.where(F.col("dataset").isNull() | ~F.col("dataset").isin(list(skip)))
    if dataset is not None:
        kept = kept.where(F.col("dataset") == dataset)
    left = not_done(kept, done, key)
    return left if limit is None else left.orderBy(key).limit(limit)


def listed(column: str, names: str | None) -> Column:
    """Whether a column is one of names parted by commas; all rows where none are given."""
    return F.lit(True) if not names else F.coalesce(F.col(column).isin([n.strip() for n in names.split(",")]), F.lit(False))


def remapped(models: DataFrame, registry: DataFrame, fixes: dict[str, str], *, skip: list[str] = (), prefixed: str = "direct") -> DataFrame:
    """(model, model_id): the registry's id, else the model's own name, either as ``fixes`` has it; ids of the backend
    ``prefixed`` without a slash get its name before them; null for models to skip."""
    known = models.select("model").join(registry.select("model", "id", "backend"), "model", "left")
    base = F.coalesce("id", "model")
    fixed = F.coalesce(F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])[base], base) if fixes else base
    full = F.when((F.col("backend") == prefixed) & ~F.contains(fixed, F.lit("/")), F.concat(F.lit(f"{prefixed}/"), fixed)).otherwise(fixed)
    return known.select("model", F.when(~F.col("model").isin(list(skip)), full).alias("model_id"))


def prompts(df: DataFrame, templates: DataFrame, think: Column) -> DataFrame:
    """``prompt``: the problem in the template of its dataset, else in that of the null one; ``/think`` and a line end before it
    where ``think`` holds. Templates: (dataset, template) with ``{problem}``, a row for each dataset."""
    named = F.broadcast(templates.where(F.col("dataset").isNotNull()).select(F.col("dataset").alias("_d"), F.col("template").alias("_t")))
    other = templates.where(F.col("dataset").isNull()).agg(F.first("template")).scalar()
    filled = F.replace(F.coalesce("_t", other), F.lit("{problem}"), F.col("problem"))
    return df.join(named, F.col("dataset") == F.col("_d"), "left").withColumn("prompt", F.concat(F.when(think, F.lit("/think\n")).otherwise(""), filled)).drop("_d", "_t")


def backfill(df: DataFrame, lookup: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Null fields filled from a lookup by key; the lookup keeps its least row of each key."""
    one = lookup.groupBy(key).agg(F.min(F.struct(*fields)).alias("_l"))
    return df.join(one, key, "left").select(*[F.coalesce(F.col(c), F.col(f"_l.{c}")).alias(c) if c in fields else F.col(c) for c in df.columns])


def either_key(df: DataFrame, lookup: DataFrame, keys: tuple[str, str], lookup_key: str, field: str, out: str) -> DataFrame:
    """A field looked up by a first key and, where that finds nothing, by a second."""
    one = lookup.groupBy(F.col(lookup_key).alias("_k")).agg(F.min(field).alias("_f"))
    first = df.join(one.select(F.col("_k").alias("_k1"), F.col("_f").alias("_f1")), F.col(keys[0]) == F.col("_k1"), "left")
    both = first.join(one.select(F.col("_k").alias("_k2"), F.col("_f").alias("_f2")), F.col(keys[1]) == F.col("_k2"), "left")
    return both.withColumn(out, F.coalesce("_f1", "_f2")).drop("_k1", "_k2", "_f1", "_f2")


def hash_order(seed: str, *keys: str) -> Column:
    """An order that any engine can compute: the MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def hash_fold(key: str, folds: int, seed: str = "42") -> Column:
    """The fold of a key, 0 to folds - 1, by its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
