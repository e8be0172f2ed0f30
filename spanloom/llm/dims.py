"""Operator names: which cluster ids stand for one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_ids(names: DataFrame, cluster: str = "cluster", name: str = "name") -> DataFrame:
    """(cluster, op): op is the smallest id whose name agrees after dropping all but letters, ignoring case.

    An id that is null is dropped; one whose name is null or has no letter stands for itself.
    An id with several names takes the smallest of their operators.
    """
    key = F.regexp_replace(F.lower(F.col(name)), r"[^\p{L}]", "")
    plain = (
        names.where(F.col(cluster).isNotNull())
        .select(F.col(cluster).cast("int").alias("cluster"), key.alias("k"))
        .withColumn("k", F.when(F.length("k") > 0, F.col("k")).otherwise(F.concat(F.lit("#"), F.col("cluster").cast("string"))))
        .distinct()
    )
    least = plain.groupBy("k").agg(F.min("cluster").alias("op"))
    return plain.join(least, "k").groupBy("cluster").agg(F.min("op").alias("op"))


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each value of ``key`` (null included), the greatest of its rows by the given columns.

    Copies are combined before the shuffle, so a key that holds a large share of all rows costs one row per task.
    """
    best = df.groupBy(F.col(key)).agg(F.max(F.struct(*columns)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])
