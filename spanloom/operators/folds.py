"""Scores out of fold: every row by a model that never saw its problem.

A group's folds are fitted beside one another, each by one task, on all labelled rows of the group in the other folds: they
come to it in order, it takes them up ``most`` at a time and holds some ten bytes for each value that isn't zero, so a fit is
bounded by its task's memory (and by 2 GB of codes, some two bytes a value, beyond which it is an error), never cut. All rows are scored where they lie.
What reaches the driver are the models, one for each group and fold: some hundred KB each, at most ``MOST_BYTES`` together,
beyond which it is an error.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.boosting import Boosted, Gathered, Logistic, Sparse, Words, ranker
from spanloom.operators.held import held
from spanloom.operators.jvm import grown
from spanloom.operators.sampling import fold_table, with_fold

MOST_BYTES = 1 << 28
#: problems whose folds a generator may draw at the driver; folds by hash have no bound
MOST_PROBLEMS = 1_000_000


def folded(df: DataFrame, problem: str, folds: int = 5, *, group: str | None = None, by: str = "hash", seed: int = 42) -> DataFrame:
    """Rows with ``fold``, the same for all rows of a problem; a null problem is one of its own.

    ``hash``: by the problem's hash. ``stride``, ``split``, ``plain``: as a generator of that kind shuffles the sorted names.
    With a ``group``, its problems in hash order are cut into as many like parts as it has fours of problems, 2 to ``folds``.
    """
    if group is not None:
        one = df.select(F.col(group).alias("_g"), F.col(problem).alias("_p")).distinct()
        w = Window.partitionBy("_g")
        n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(F.md5(F.coalesce("_p", F.lit(""))), "_p")) - 1
        k = F.least(F.lit(folds), F.greatest(F.lit(2), F.floor(n / 4)))
        table = one.select("_g", "_p", F.floor(rank * k / n).cast("int").alias("fold"))
        return df.join(table, F.col(group).eqNullSafe(F.col("_g")) & F.col(problem).eqNullSafe(F.col("_p"))).drop("_g", "_p")
    if by == "hash":
        return with_fold(df, problem, folds, str(seed)).withColumn("fold", F.coalesce("fold", F.lit(0)))
    names = [r[0] for r in df.select(problem).where(F.col(problem).isNotNull()).distinct().limit(MOST_PROBLEMS + 1).collect()]
    if len(names) > MOST_PROBLEMS:
        raise ValueError(f"more than {MOST_PROBLEMS} problems: take folds by hash")
    table = df.sparkSession.createDataFrame(list(fold_table(names, folds, seed, by).items()), "_p string, fold int")
    return df.join(table, F.col(problem) == F.col("_p"), "left").drop("_p").withColumn("fold", F.coalesce("fold", F.lit(0)))


def _dense(x: pa.Array) -> np.ndarray:
    """The rows of a column of lists that are as long as one another."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(x), -1)


def _both(words: Words, texts: pa.ListArray, x: np.ndarray, sparse: bool) -> np.ndarray | Sparse:
    return words.entries(texts).beside(Sparse.of(x)) if sparse else np.c_[words.weights(texts), x]


def _said(words: pa.Array) -> pa.ListArray:
    """The words of each text, which blanks part."""
    parts = pc.split_pattern(pc.fill_null(words, ""), " ")
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    there = pc.not_equal(parts.flatten(), "")
    row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))[there.to_numpy(zero_copy_only=False)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.bincount(row, minlength=len(parts))]), pa.int32()), parts.flatten().filter(there))


def out_of_fold(
    rows: DataFrame, key: str, label: str, x: str, *, kind: str = "boosted", group: str | None = None, problem: str | None = None, tokens: str | None = None, carry: tuple[str, ...] = (), train: str = "true",
    classes: list[str] | None = None, most: int = 20_000, least: int = 2, tasks: int = 64, **options,
) -> DataFrame:
    """(key, carry, score), or with ``classes`` (key, carry, probs): of every row by the model of the other folds.

    ``rows`` have ``fold``. ``kind``: boosted, logistic or ranker (with ``problem``). ``tokens``: a column of words whose
    weights, fitted with each fold, stand beside ``x``; words hold no blanks. ``train``: which rows may be fitted to; all are scored. ``most``: rows
    that a task takes up at a time, all that there are in turn. ``classes``: the labels in order, else they are 0 and 1. Null where a group has fewer than ``least`` labelled rows or its training
    folds one class only.
    """
    spark = rows.sparkSession
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    code = F.col(label).cast("double") if classes is None else (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double")
    extra = [F.array_join(tokens, " ").alias("_t")] if tokens else []  # far smaller than a list
    data = rows.select(key, *carry, g.alias("_g"), F.col("fold").alias("_fold"), (F.col(problem).cast("string") if problem else F.lit(None).cast("string")).alias("_p"), code.alias("_y"), F.col(x).cast("array<float>").alias("_x"), *extra, F.expr(train).alias("_in"))
    data = held(data)
    fit_on = data.where(F.col("_in") & F.col("_y").isNotNull() & (F.col("_y") >= 0))
    sizes = fit_on.groupBy(F.col("_g").alias("_h")).agg(F.count("*").alias("_n"), F.count_distinct("_y").alias("_k")).where((F.col("_n") >= least) & (F.col("_k") > 1))
    known = fit_on.join(F.broadcast(sizes), F.col("_g").eqNullSafe(F.col("_h")))
    needed = data.select(F.col("_g").alias("_n1"), F.col("_fold").alias("_f")).distinct()  # groups x folds
    wanted = known.join(F.broadcast(needed), F.col("_g").eqNullSafe(F.col("_n1")) & (F.col("_fold") != F.col("_f")))
    wanted = wanted.select(key, "_g", "_f", "_p", "_y", "_x", *(["_t"] if tokens else []))
    n_classes = 2 if classes is None else len(classes)

    kinds = pa.schema([("_g", pa.string()), ("_f", pa.int32()), ("model", pa.binary()), ("sample", pa.binary())])

    def fitted(at: tuple, labels: list, gathered: Gathered, problems: list) -> Iterator[pa.RecordBatch]:
        y = np.concatenate(labels)
        if len(np.unique(y)) < 2:
            return
        x, words = gathered.done()
        sample = None
        if kind == "boosted":
            model = Boosted(**options)
            sample = model.packed(x, y, n_classes, len(words.place) if words else 0)
        else:
            dense = np.zeros(x.shape, dtype=np.float32)
            dense[x.row, x.col] = x.value
            model = ranker(dense, y, np.array(problems), **options) if kind == "ranker" else Logistic(**options).fit(dense, y, n_classes)
        state = pickle.dumps((words and words.state(), type(model).__name__, model.state()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, state, sample), kinds.types)], schema=kinds)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            begin = 0
            for at, run in itertools.groupby(zip(b.column("_g").to_pylist(), b.column("_f").to_pylist())):
                end = begin + sum(1 for _ in run)
                if now is None or now[0] != at:
                    if now is not None:
                        yield from fitted(*now)
                    now = (at, [], Gathered(bool(tokens), kind == "boosted"), [])
                for i in range(begin, end, most):
                    part = b.slice(i, min(most, end - i))
                    now[1].append(part.column("_y").to_numpy().astype(np.int64))
                    now[2].add(_dense(part.column("_x")), _said(part.column("_t")) if tokens else None)
                    if kind == "ranker":
                        now[3].extend(part.column("_p").fill_null("").to_pylist())
                begin = end
        if now is not None:
            yield from fitted(*now)

    # a number of partitions of its own, for each group is long work and must not be put together with others
    begun = wanted.repartition(tasks, "_g", "_f").sortWithinPartitions("_g", "_f", key).mapInArrow(fit, "_g string, _f int, model binary, sample binary")
    made = held(begun.select("_g", "_f", "model", grown(spark, F.col("sample")).alias("trees")))
    if (made.agg(F.sum(F.length("model") + F.coalesce(F.length("trees"), F.lit(0)))).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"models of more than {MOST_BYTES} bytes: score the groups one after another")
    models = {(r["_g"], r["_f"]): (bytes(r["model"]), r["trees"] and bytes(r["trees"])) for r in made.collect()}  # groups x folds
    shared = spark.sparkContext.broadcast(models)
    keep = [key, *carry]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for b in batches:
            groups, folds = (b.column(i).to_pylist() for i in range(len(keep), len(keep) + 2))
            x = _dense(b.column(len(keep) + 2)) if b.num_rows else None
            texts = _said(b.column(len(keep) + 3)) if tokens else None
            out: list = [None] * b.num_rows
            parts: dict = {}
            for i, at in enumerate(zip(groups, folds)):
                parts.setdefault(at, []).append(i)
            for at, own in parts.items():
                if at not in shared.value:
                    continue
                if at not in made:
                    (held_words, name, state), trees = pickle.loads(shared.value[at][0]), shared.value[at][1]
                    model = {"Boosted": Boosted, "Logistic": Logistic}[name].of(**state)
                    made[at] = (Words.of(*held_words) if held_words else None, model if trees is None else model.taken(trees))
                words, model = made[at]
                p = model.predict(x[own] if words is None else _both(words, texts.take(pa.array(own)), x[own], isinstance(model, Boosted)))
                for i, v in zip(own, p.tolist() if classes else p[:, 1].tolist()):
                    out[i] = v
            kind_ = pa.list_(pa.float64()) if classes else pa.float64()
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(out, kind_)], [*keep, "probs" if classes else "score"])

    types = ", ".join(f"`{c}` {t}" for c, t in data.select(*keep).dtypes)
    # rows of a model together, for many at once cost little more than a few
    given = data.select(*keep, "_g", "_fold", "_x", *(["_t"] if tokens else [])).sortWithinPartitions("_g", "_fold")
    return given.mapInArrow(score, f"{types}, {'probs array<double>' if classes else 'score double'}")
