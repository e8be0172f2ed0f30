"""Public benchmarks' raw rows brought to the columns of ``problems``.

Each reshape takes the rows of one benchmark as its publisher gives them (JSON lines or Parquet, read by ``jsonl`` or Spark)
and gives (problem_id, problem, answer, ...) with text columns only. Ids that the rows lack are made from their place, which
must be given as ``row``, from 0. Missing columns are null; options are lettered from A. Nothing is fetched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["problem_id", "problem", "answer", "subject", "level", "url", "test_cases", "starter_code", "answer_type", "category", "task", "test", "entry_point", "canonical"]
# The categories that are kept of a benchmark of many.
CATEGORIES = ["philosophy", "history", "law", "psychology", "economics", "business", "other", "political_science"]


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    made = {c: (columns[c] if c in columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS}
    return df.select(*made.values())


def _of(df: DataFrame, name: str, otherwise: str | None = None) -> Column:
    """The column, or null (``otherwise``) where the rows don't have it."""
    return F.col(name) if name in df.columns else F.lit(otherwise)


def _id(prefix: str, digits: int) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("row").cast("string"), digits, "0"))


def options(texts: Column) -> Column:
    """The options as lines, lettered from A."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("("), F.char(65 + i), F.lit(") "), t)), "\n")


def shuffled(texts: Column, *keys: Column) -> Column:
    """The options in an order by hash that only depends on keys and texts."""
    return F.transform(F.sort_array(F.transform(texts, lambda t: F.struct(F.md5(F.concat_ws(":", *keys, t)).alias("h"), t.alias("t")))), lambda x: x["t"])


def _asked(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n\n"), choices)


def competition(df: DataFrame) -> DataFrame:
    return _made(df, problem_id=F.col("unique_id"), problem=F.col("problem"), answer=F.col("answer"), subject=_of(df, "subject", ""), level=_of(df, "level", ""))


def integers(df: DataFrame, prefix: str = "aime") -> DataFrame:
    return _made(df, problem_id=_id(prefix, 3), problem=F.col("problem"), answer=F.col("answer"), url=_of(df, "url", ""))


def four_choices(df: DataFrame, prefix: str = "gpqa") -> DataFrame:
    """A right and three wrong answers, shuffled by problem; the answer is the right one's letter, the first of equal ones."""
    named = df.select("row", F.col("Question").alias("q"), F.col("Correct Answer").alias("right"), F.array("Correct Answer", *[f"Incorrect Answer {i}" for i in (1, 2, 3)]).alias("all"))
    mixed = named.withColumn("mixed", shuffled(F.col("all"), F.col("row").cast("string")))
    return _made(mixed, problem_id=_id(prefix, 4), problem=_asked(F.col("q"), options(F.col("mixed"))), answer=F.char(64 + F.array_position("mixed", F.col("right"))))


def programs(df: DataFrame, prefix: str = "lcb") -> DataFrame:
    cases = _of(df, "public_test_cases", "[]")
    nested = "public_test_cases" in df.columns and df.schema["public_test_cases"].dataType.typeName() != "string"
    key = F.coalesce(_of(df, "question_id").cast("string"), _id(prefix, 4))
    return _made(df, problem_id=key, problem=F.col("question_content"), answer=F.lit(""), test_cases=F.to_json(cases) if nested else cases, starter_code=_of(df, "starter_code", ""))


def mixed_forms(df: DataFrame, prefix: str = "hle") -> DataFrame:
    kind = F.when(_of(df, "answer_type") == "multiple_choice", F.lit("multiple_choice")).otherwise("exact_match")
    return _made(df, problem_id=_id(prefix, 4), problem=F.col("question"), answer=F.col("answer"), answer_type=kind, subject=_of(df, "subject", ""))


def many_choices(df: DataFrame, prefix: str = "mmlu_pro", categories: list[str] = CATEGORIES) -> DataFrame:
    kept = df.where(F.replace(F.lower(F.coalesce("category", F.lit(""))), F.lit(" "), F.lit("_")).isin(categories) & (F.size("options") > 0))
    return _made(kept, problem_id=_id(prefix, 5), problem=_asked(F.col("question"), options(F.col("options"))), answer=F.col("answer"), category=F.col("category"))


def labelled_choices(df: DataFrame, prefix: str = "arc") -> DataFrame:
    lines = F.transform(F.arrays_zip(F.col("choices.label").alias("l"), F.col("choices.text").alias("t")), lambda c: F.concat(F.lit("("), c["l"], F.lit(") "), c["t"]))
    return _made(df, problem_id=_id(prefix, 4), problem=_asked(F.col("question"), F.array_join(lines, "\n")), answer=F.col("answerKey"))


def tasks(df: DataFrame, prefix: str = "bbh") -> DataFrame:
    """Rows of several tasks, ``task`` and the place within it (``row``) given."""
    key = F.concat_ws("_", F.lit(prefix), "task", F.lpad(F.col("row").cast("string"), 3, "0"))
    return _made(df, problem_id=key, problem=F.col("input"), answer=F.col("target"), task=F.col("task"))


def functions(df: DataFrame) -> DataFrame:
    return _made(df, problem_id=F.col("task_id"), problem=F.col("prompt"), answer=F.lit(""), test=F.col("test"), entry_point=F.col("entry_point"), canonical=_of(df, "canonical_solution", ""))


def grids(df: DataFrame, prefix: str = "arc_agi2") -> DataFrame:
    """Tasks (name, train and test: arrays of input and output grids): a problem for each test, the grids as JSON."""
    each = df.select("name", "train", F.posexplode("test").alias("k", "t"))
    shown = F.transform("train", lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\nInput: "), _json(e["input"]), F.lit("\nOutput: "), _json(e["output"]), F.lit("\n\n")))
    key = F.concat_ws("_", F.lit(prefix), "name", F.col("k").cast("string"))
    return _made(each, problem_id=key, problem=F.concat(F.array_join(shown, ""), F.lit("Test input: "), _json(F.col("t.input"))), answer=_json(F.coalesce("t.output", F.expr("array()"))))


def _json(grid: Column) -> Column:
    """JSON with blanks after commas."""
    return F.replace(F.to_json(grid), F.lit(","), F.lit(", "))


#: The public benchmarks' names and their reshapes.
RESHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "math": competition, "gpqa": four_choices, "aime": integers, "livecodebench": programs, "hle": mixed_forms, "mmlu_pro": many_choices, "arc_challenge": labelled_choices, "bbh": tasks,
    "humaneval": functions, "arc_agi2": grids,
}


def problems(name: str, raw: DataFrame, n: int | None = None, seed: str = "42") -> DataFrame:
    """A benchmark's problems; ``n`` of them in hash order, if given. An unknown name is an error."""
    if name not in RESHAPES:
        raise ValueError(f"unknown benchmark {name!r}; known: {sorted(RESHAPES)}")
    made = RESHAPES[name](raw)
    return made if n is None else made.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "problem_id")), "problem_id").limit(n)
