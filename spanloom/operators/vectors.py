"""Vectors as arrays: similarity, centroids, neighbours, pairs within and across groups, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from the first place to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): the mean vector. Means of each place are combined in every task before the shuffle."""
    parts = df.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def nearest(df: DataFrame, centers: DataFrame, group: str, vector: str, key: str, k: int) -> DataFrame:
    """The ``k`` members of each group nearest to its centroid, ties by key."""
    d = df.join(centers.select(group, "centroid"), group).select(group, key, distance(F.col(vector), F.col("centroid")).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", key))).where(F.col("rank") <= k)


def group_pairs(df: DataFrame, group: str, part: str, vector: str) -> DataFrame:
    """(group, a, b, cosine) of the members of a group, told apart by ``part``: for groups of a few named members, such as the
    judges of one cluster."""
    a = df.select(group, F.col(part).alias("a"), F.col(vector).alias("va"))
    b = df.select(group, F.col(part).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, group).where("a < b").select(group, "a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def hashed_pairs(df: DataFrame, key: str, group: str, vector: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` pairs of different groups: each row of the first 2n in hash order meets the next row of another group, so the pairs
    are random and linear in number. Fewer only where no more rows have one."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    picked = df.where(F.col(group).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(vector).alias("v"), h.alias("h")).orderBy("h", "k").limit(2 * n)
    order = Window.orderBy("h", "k")  # 2n rows, a parameter of the sample
    marked = picked.withColumn("new", F.coalesce((F.lag("g").over(order) != F.col("g")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    starts = marked.where("new = 1").select((F.col("run") - 1).alias("run"), F.col("k").alias("k2"), F.col("g").alias("g2"), F.col("v").alias("v2"))
    return marked.join(starts, "run").orderBy("h", "k").limit(n).select("k", "k2", "g", "g2", cosine(F.col("v"), F.col("v2")).alias("cosine"))


def density(df: DataFrame, value: str, grid: list[float], factor: float = 0.15) -> DataFrame:
    """(x, density): Gaussian kernel estimate at each point, its width ``factor`` times the sample's deviation."""
    stats = df.agg(F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    width = F.col("s") * factor
    points = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.explode(F.array(*map(F.lit, grid))).alias("x"))
    wide = points.withColumn("_k", F.lit(1)).join(F.broadcast(stats.withColumn("_k", F.lit(1))), "_k")  # one row
    kernel = F.exp(-(((F.col("x") - F.col("v")) / width) ** 2) / 2) / (width * 2.5066282746310002)
    return wide.groupBy("x").agg(F.avg(kernel).alias("density"))


def char_ngram_vectors(df: DataFrame, key: str, n: int = 3, slots: int = 64) -> DataFrame:
    """(key, x): unit vectors of the hashed n-grams of the key's signs, a stand-in for a learned embedding."""
    padded = F.concat(F.lit("^"), F.lower(key), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))
    slot = F.pmod(F.xxhash64("g"), F.lit(slots)).cast("int")
    counts = df.select(key, F.explode(grams).alias("g")).groupBy(key, slot.alias("s")).agg(F.count("*").cast("double").alias("c"))
    per = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
    x = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0.0)) / F.col("l"))
    return per.select(key, x.alias("x"))
