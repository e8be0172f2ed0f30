"""Samples and folds that any engine can repeat: by the MD5 of a seed and the key, never by a generator's state."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.traces import hash_fold, hash_order


def sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows in hash order."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def balanced(df: DataFrame, groups: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows of each group in hash order."""
    order = Window.partitionBy(*groups).orderBy(hash_order(seed, key), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def stratified(df: DataFrame, groups: list[str], key: str, total: int, seed: str = "42") -> DataFrame:
    """As many rows of each cell as ``total`` gives it, one at least. The cells are counted first, one row each."""
    cells = df.select(*groups).distinct().agg(F.count("*")).scalar()
    order = Window.partitionBy(*groups).orderBy(hash_order(seed, key), key)
    per = F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(cells, F.lit(1))))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per)


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: str = "42") -> DataFrame:
    """The fold of each row's problem; all rows of a problem share it."""
    return df.withColumn("fold", hash_fold(key, folds, seed))


def fold_table(problems: list[str], folds: int = 5, seed: int = 42, kind: str = "stride") -> dict[str, int]:
    """Folds of a list of problems by a generator: ``stride`` and ``split`` with numpy's, ``plain`` with the standard one's.

    For lists that fit the driver; ``with_fold`` has no such bound.
    """
    names = sorted(set(problems))
    if kind == "plain":
        random.Random(seed).shuffle(names)
        return {p: i % folds for i, p in enumerate(names)}
    if kind == "stride":
        order = np.arange(len(names))
        np.random.default_rng(seed).shuffle(order)
        return {names[j]: i % folds for i, j in enumerate(order)}
    order = np.arange(len(names))
    np.random.RandomState(seed).shuffle(order)
    return {names[j]: f for f, part in enumerate(np.array_split(order, folds)) for j in part}


def contrast_pairs(df: DataFrame, problem: str, key: str, label: str, most: int = 16) -> DataFrame:
    """(problem, pos, neg): of each problem with both labels ``most`` pairs; sides with fewer traces are repeated in turn, so that
    problems weigh alike.

    Both sides are numbered in hash order and cut to ``most`` before they meet, so a problem gives at most that many rows.
    """
    order = Window.partitionBy(problem, label).orderBy(hash_order("42", key), key)
    numbered = df.where(F.col(label).isNotNull()).select(problem, F.col(key).alias("k"), F.col(label).alias("y"), (F.row_number().over(order) - 1).alias("i")).where(F.col("i") < most)
    side = lambda y, name: numbered.where(F.col("y") == y).groupBy(problem).agg(F.sort_array(F.collect_list(F.struct("i", "k"))).alias(name))
    both = side(True, "p").join(side(False, "q"), problem)
    each = both.select(problem, "p", "q", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("j"))
    return each.select(problem, F.get("p", F.col("j") % F.size("p"))["k"].alias("pos"), F.get("q", F.col("j") % F.size("q"))["k"].alias("neg"))
