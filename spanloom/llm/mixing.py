"""Documents drawn so that sources get target shares of all tokens, by hierarchical budgets.

Weights go down a tree of domains (kinds of document), their languages and their sources. A node that can't hold its
budget, all of its documents used as often as allowed, leaves the shortage to its siblings and only what these can't take
to the nodes above. As that favours the siblings of a source that falls short, the leaves' weights are fitted until every
source has its share of what is drawn, or all that it can give. A leaf's budget is filled by whole epochs of its documents
and a prefix of one more, in an order seeded by epoch.

Null and empty texts have no tokens and are never drawn. A source without a target isn't drawn; a target without documents
stays unmet, and its share goes to the others. A null domain or language is one of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.langid import label_language
from spanloom.operators.held import held

#: rows of the plan at the driver: domains x languages x sources, and targets; more is an error, not a cut
MOST_LEAVES = 100_000
LEAF = ["domain", "lang", "source"]


def source_key(source: Column) -> Column:
    """One spelling of a source's name: lower case, words joined by low lines."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)[\s_.-]+", "_"), "^_+|_+$", "")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(sizes, pa.int64())], [*names, "tokens"])

    return run


def count_tokens(docs: DataFrame, keys: dict[str, str], text: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """The key columns (name -> type) and ``tokens``, the number of tokens of the text. ``tokenizer``: a file of ranks that every machine holds."""
    schema = ", ".join([*[f"`{k}` {t}" for k, t in keys.items()], "tokens long"])
    return docs.select(*keys, text).mapInArrow(_counter(tokenizer or default_tokenizer()), schema)


def fill(capacity: dict[str, float], weight: dict[str, float], total: float) -> dict[str, float]:
    """Budgets of siblings by weight: none over its capacity, shortages shared among those with room, as far as they go."""
    out = dict.fromkeys(capacity, 0.0)
    room = {k for k in capacity if capacity[k] > 0 and weight.get(k, 0) > 0}
    left = total
    while room and left > 1e-9:
        whole = sum(weight[k] for k in room)
        full = {k for k in room if capacity[k] - out[k] <= left * weight[k] / whole}
        if not full:
            for k in room:
                out[k] += left * weight[k] / whole
            break
        for k in full:
            left -= capacity[k] - out[k]
            out[k] = capacity[k]
        room -= full
    return out


def budgets(leaves: dict[tuple[str, ...], tuple[int, int]], weights: dict[tuple[str, ...], float], total: float, nodes: dict[tuple[str, ...], float] | None = None) -> dict[tuple[str, ...], float]:
    """The budget of each leaf (path -> (tokens, most repeats)) by the leaves' weights; a node weighs what its leaves do,
    or what ``nodes`` gives it. Siblings are filled before their parent's shortage reaches its own siblings, for a parent's
    capacity is the sum of its children's."""
    nodes = nodes or {}

    def level(prefix: tuple[str, ...], paths: list[tuple[str, ...]], amount: float) -> dict[tuple[str, ...], float]:
        if len(paths) == 1 and paths[0] == prefix:
            return {prefix: amount}
        children: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for p in paths:
            children[p[len(prefix)]].append(p)
        capacity = {c: float(sum(leaves[p][0] * leaves[p][1] for p in ps)) for c, ps in children.items()}
        weight = {c: nodes.get((*prefix, c), sum(weights[p] for p in ps)) for c, ps in children.items()}
        out: dict[tuple[str, ...], float] = {}
        for c, got in fill(capacity, weight, amount).items():
            out |= level((*prefix, c), children[c], got)
        return out

    return level((), sorted(leaves), total) if leaves else {}


def source_budgets(leaves: dict[tuple[str, ...], tuple[int, int]], shares: dict[str, float], total: float, nodes: dict[tuple[str, ...], float] | None = None, rounds: int = 200) -> dict[tuple[str, ...], float]:
    """Budgets of leaves (domain, language, source) that give each source its share, as far as its documents and the weights
    of ``nodes`` allow: in each round the leaves of a source weigh more or less by what it lacks or has too much."""
    tokens, capacity = defaultdict(float), defaultdict(float)
    for p, (n, most) in leaves.items():
        tokens[p[-1]] += n
        capacity[p[-1]] += n * most
    goals = fill(dict(capacity), shares, total)
    weights = {p: shares.get(p[-1], 0.0) * n / tokens[p[-1]] for p, (n, _) in leaves.items()}
    out: dict[tuple[str, ...], float] = {}
    for _ in range(rounds):
        out = budgets(leaves, weights, total, nodes)
        got = defaultdict(float)
        for p, b in out.items():
            got[p[-1]] += b
        if all(abs(got[s] - goals[s]) <= 1e-6 * total for s in goals):
            break
        weights = {p: w * (goals[p[-1]] / got[p[-1]] if got[p[-1]] > 0 else 1.0) for p, w in weights.items()}
    return out


def _plan(docs: DataFrame, targets: DataFrame, total: int | None, weights: dict[tuple[str, ...], float] | None, tokenizer: str | None) -> tuple[DataFrame, list[tuple]]:
    spark = docs.sparkSession
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    rows = wanted.limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} targets")
    domain = F.coalesce(F.col("doc_kind"), F.lit("")) if "doc_kind" in docs.columns else F.lit("")
    named = docs.select("doc_id", domain.alias("domain"), source_key(F.col("source")).alias("source"), F.coalesce(label_language(F.col("lang")), F.lit("und")).alias("lang"), "text")
    named = named.join(wanted.select("source"), "source", "left_semi")
    one = count_tokens(named, {"doc_id": "long", "domain": "string", "source": "string", "lang": "string"}, tokenizer=tokenizer).groupBy("doc_id").agg(F.max(F.struct("domain", "source", "lang", "tokens")).alias("v"))
    counted = held(one.select("doc_id", "v.*").where(F.col("tokens") > 0))
    sums = counted.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} domains, languages and sources together")
    repeats, shares = {r.source: int(r.max_repeats or 0) for r in rows}, {r.source: float(r.target_share or 0) for r in rows}
    leaves = {(r.domain, r.lang, r.source): (int(r.tokens), repeats[r.source]) for r in sums}
    goal = sum(t for t, _ in leaves.values()) if total is None else total
    plan = []
    for path, budget in sorted(source_budgets(leaves, shares, goal, weights).items()):
        size, most = leaves[path]
        amount = min(round(budget), size * most)
        epochs, rest = divmod(amount, size)
        plan.append((*path, epochs, rest))
    return counted, [rows, goal, plan]


def mixture(
    docs: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 17, weights: dict[tuple[str, ...], float] | None = None, tokenizer: str | None = None, slots: int = 4096
) -> DataFrame:
    """(doc_id, domain, source, lang, tokens, repeats) of the documents drawn, each repeated at most as often as its source allows.

    ``total``: tokens wanted in all; by default those of the documents whose source has a target. ``weights``: of nodes of the
    tree, (domain,) or (domain, language) or (domain, language, source), where they aren't to follow from the shares. The prefix of a leaf's
    last epoch is found by the sums of ``slots`` ranges of its hash order and, within the one range where it ends, document
    by document: no task orders a whole leaf, however large.
    """
    counted, (_, _, plan) = _plan(docs, targets, total, weights, tokenizer)
    spark = docs.sparkSession
    leaves = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, epochs long, rest long"))  # at most MOST_LEAVES
    seeded = counted.join(leaves, LEAF).withColumn("h", F.xxhash64(F.lit(seed), "epochs", "doc_id")).withColumn("slot", F.pmod("h", F.lit(slots)))
    order = Window.partitionBy(*LEAF).orderBy("slot")
    sums = seeded.where(F.col("rest") > 0).groupBy(*LEAF, "rest", "slot").agg(F.sum("tokens").alias("size"))
    ranges = sums.select("*", (F.sum("size").over(order) - F.col("size")).alias("before"))
    last = ranges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).select(
        *LEAF, F.col("slot").alias("last"), (F.col("rest") - F.col("before")).alias("need")
    )
    marked = seeded.join(last, LEAF, "left")
    edge = marked.where(F.col("slot") == F.col("last"))
    inner = Window.partitionBy(*LEAF).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ended = edge.select("*", F.sum("tokens").over(inner).alias("upto")).withColumn("extra", F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("need"), 1).otherwise(0))
    clear = marked.where(F.col("last").isNull() | (F.col("slot") != F.col("last"))).withColumn("extra", F.when(F.col("slot") < F.col("last"), 1).otherwise(0))
    columns = ["doc_id", "domain", "source", "lang", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("repeats")]
    return clear.select(*columns).unionByName(ended.select(*columns)).where(F.col("repeats") > 0)


def mixture_shares(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, documents, draws, tokens, actual_share, most_repeats) of every target, drawn or not."""
    drawn = mixture(docs, targets, **options)
    got = drawn.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("draws"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    wanted = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(got, "source", "left").fillna(0, ["documents", "draws", "tokens", "most_repeats"])
    return both.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # a row for each target
