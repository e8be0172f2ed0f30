"""JSON lines: strict, tolerant and keyed reading, folders with columns in their paths, dimensions, writing, resuming.

Schemas are given, never inferred, so that a missing field is null and reading is one pass. Spark reads blank lines as
nothing. A gzip file can't be split: each is one task, and rows are spread after it.
"""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE_SCHEMA = (
    "trace_id string, model string, model_family string, dataset string, problem_id string, sample int, problem string, gold_answer string, model_response string, reasoning string, "
    "correct boolean, truncated boolean, finish_reason string"
)


def read_strict(spark: SparkSession, path: str | list[str], schema: str, partitions: int | None = None) -> DataFrame:
    """A line that can't be parsed fails the job."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    return df.repartition(partitions) if partitions else df


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): bad lines are kept aside, not lost."""
    wide = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    bad = parsed.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return parsed.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), bad


def read_keyed(spark: SparkSession, path: str | list[str], schema: str, key: str, by: list[str]) -> DataFrame:
    """Each key's last row by the columns ``by``; later files and lines decide where those are equal."""
    df = read_strict(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())
    fields = [c for c in T.StructType.fromDDL(schema).names if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*by, "_at")).alias("_v"))
    return last.select(key, *[F.col(f"_v.{c}").alias(c) for c in fields])


def read_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``sample_*/model/dataset/*.json`` with sample, model and dataset taken from the path. Files that begin with a low line
    and files that can't be parsed are left out."""
    wide = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    df = spark.read.schema(wide).option("multiLine", True).json(f"{root}/sample_*/*/*/*.json", mode="PERMISSIVE")
    path = F.col("_metadata.file_path")
    part = lambda g: F.regexp_extract(path, r"sample_(\d+)/([^/]+)/([^/]+)/[^/]+$", g)
    rows = df.select("*", part(1).cast("int").alias("sample"), part(2).alias("model"), part(3).alias("dataset"))
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_dimension(spark: SparkSession, path: str, value: str = "struct<name:string,description:string>") -> DataFrame:
    """(key, ...) of a file that holds one JSON object of names."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", T.MapType(T.StringType(), T._parse_datatype_string(value))))
    return text.select(entries.alias("key", "v")).select("key", "v.*" if value.startswith("struct") else F.col("v").alias("value"))


def read_config(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text())


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    df.write.mode(mode).option("compression", compression).json(path)


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Parquet, in folders by the columns ``by``."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Separated values with a header; arrays become JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c, f in zip(df.columns, df.schema)])
    flat.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str, key: str | tuple[str, ...] = "trace_id", buckets: int = 64) -> DataFrame:
    """Appends the rows whose key the folder doesn't hold yet, each key once; gives back all it holds then. Can be run again
    after a stop. Null keys are never new.

    The folder is parted by the hash of the first key column, and only its keys in the parts that the new rows fall in are
    read: a batch of few keys reads few parts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).cast("int")
    todo = df.where(F.col(keys[0]).isNotNull()).dropDuplicates(keys).withColumn("_part", part)
    if _exists(spark, path):
        touched = [r[0] for r in todo.select("_part").distinct().collect()]  # at most ``buckets``
        held = spark.read.parquet(path).where(F.col("_part").isin(touched)).select(*keys).distinct()
        todo = todo.join(held, keys, "left_anti")
    todo.write.mode("append").partitionBy("_part").parquet(path)
    return spark.read.schema(todo.select(*df.columns, "_part").schema).parquet(path).drop("_part")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def run_summary(df: DataFrame) -> DataFrame:
    """(model, dataset, total, labelled, accuracy) of saved rows."""
    out = df.groupBy("model", "dataset").agg(F.count("*").alias("total"), F.count("correct").alias("labelled"), F.count_if("correct").alias("_c"))
    return out.select("model", "dataset", "total", "labelled", F.try_divide(F.col("_c"), F.col("labelled")).alias("accuracy"))
