"""Values that stop before their text was finished.

The statistic is that of word trigrams inside texts and at ends. Every word, number (all alike) and mark of every value is
a token; of each trigram it is counted how often it occurs and how often an end follows: the end of the line or the value,
or, after a word, a sentence mark. A value whose last trigram is frequent but almost never followed by an end was cut.
A value's end may be a cut itself: where a trigram ends hardly anywhere but with values, and few of those that begin like it
are that one, it tells nothing. There, and where it is new, its first two words decide: if words of one text are rare after
them, a piece of a word stands there; else the same figures of them with any third word hold. So pieces that recur, as they do
in large tables and with copies of a text under other keys, are found like new ones. Scripts without blanks use six signs in place of three words. Marks left by a cut, delimiters left open and
lengths at which a back end stops are told apart before, all in SQL expressions: no Python runs.

Two reads of the texts give all of it, and no text is shuffled: the first tells of each delivery what its values end like
and a hash, the second counts the trigrams. Deliveries of one trace count once, that with the most text, of equally long
ones that with the greatest hash; its equal copies share one weight in the second read. A null value or one without a
letter or digit is no case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.held import held
from spanloom.llm.truncation_text import ANSWER_END, BARE, BLANKS, CUT_MARK, LABEL_ONLY, SENTENCE_END, TOKEN

FIELDS = ("reasoning", "model_response")
#: repeated traces at most that are sent to every task (some 40 bytes each); more are joined by shuffles
SENT = 200_000


def delivery_hash(*columns: str) -> Column:
    """What tells deliveries of one trace apart: equal for equal values, nulls included."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _trimmed(c: str) -> Column:
    """Without blanks at the end; most values have none."""
    return F.when(F.right(c, F.lit(1)).isin(*BLANKS), F.rtrim(F.col(c), F.lit(BLANKS))).otherwise(F.col(c))


def _tokens(text: Column) -> Column:
    """The tokens of a text after two that stand for its beginning."""
    plain = F.regexp_replace(F.lower(text), r"\p{Nd}+(?:[.,]\p{Nd}+)*", "0")
    return F.concat(F.array(F.lit("^"), F.lit("^")), F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)))


def _grams(toks: Column) -> Column:
    """Array of the tokens with those around them: t5 to t1 before, t0, and t6 after it (null at the end)."""
    padded = F.concat(F.array_repeat(F.lit("^"), 3), toks)
    n = F.size(toks) - 2
    shifted = [F.slice(padded, 6 - k, n + k) for k in (5, 4, 3, 2, 1, 0)] + [F.slice(padded, 7, F.greatest(n - 1, F.lit(0)))]
    zipped = F.arrays_zip(*[x.alias(name) for x, name in zip(shifted, ("t5", "t4", "t3", "t2", "t1", "t0", "t6"))])
    return F.slice(zipped, 1, F.greatest(n, F.lit(0)))


def _keys(t: str) -> tuple[Column, Column]:
    """(context, gram): hash keys of the trigram that ends at t0 without and with its last token.

    Where words aren't parted by blanks six signs take the place of three words. Of a full stop only the word before it
    counts, of one after a single letter also what precedes that.
    """
    at = [F.col(f"{t}.t{k}") for k in range(6)]
    sign = (F.length(at[0]) == 1) & (at[0] >= "฀")
    far = [F.when(sign, at[k]) for k in (5, 4, 3)]
    second = F.when((at[0] == ".") & (F.length(at[1]) > 1), F.lit("*")).otherwise(at[2])
    return F.xxhash64(*far, second, at[1]), F.xxhash64(*far, second, at[1], at[0])


def _ends(t: str) -> Column:
    """Whether an end follows t0: of the line or text; after a word also a sentence mark."""
    nxt, this = F.col(f"{t}.t6"), F.col(f"{t}.t0")
    line = nxt.isNull() | nxt.startswith("\n") | (nxt == " ")
    return line | (~this.isin(*".!?") & nxt.isin(*".!?。！？।؟"))


def trigram_ends(vals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, gram, n, ends, stops, alone) of every trigram of every value (text, weight), and the same by context, ``alone``
    being the number of those whose word stands in one text only.

    ``stops``: how often the value itself stops there; ``alone``: whether all lie in equal texts. Combined in each task before the shuffle, first by trigram, then by context. The weights of equal copies add up to one.
    """
    grams = vals.where(F.col("text").isNotNull()).select("weight", F.hash("text").alias("of"), _tokens(F.col("text")).alias("toks")).select("weight", "of", F.explode(_grams(F.col("toks"))).alias("t"))
    context, gram = _keys("t")
    whole = lambda c: F.round(F.sum(c)).cast("long")
    exact = (
        grams.select(
            "weight", "of", context.alias("context"), gram.alias("gram"), F.when(_ends("t"), F.col("weight")).otherwise(0.0).alias("e"), F.when(F.col("t.t6").isNull(), F.col("weight")).otherwise(0.0).alias("s")
        )
        .groupBy("context", "gram")
        .agg(whole("weight").alias("n"), whole("e").alias("ends"), whole("s").alias("stops"), (F.min("of") == F.max("of")).alias("alone"))
    )
    return exact, exact.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("n", "ends", "stops")], F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("alone"))


def limits(vals: DataFrame, *, least_length: int = 100, least_count: int = 8, one_share: float = 0.02, ten_share: float = 0.08) -> DataFrame:
    """(_m, _f, _ten, _top, _all): where the lengths of one model's values of a field pile up, by tens.

    ``_top``: one length that holds ``one_share`` of the values, where a back end counts signs; ``_all``: the whole ten
    holds ``ten_share``, where it stops at the word before its limit.
    """
    sizes = vals.where(F.col("len").isNotNull()).groupBy("model", "field", "len").agg(F.count("*").alias("n"))
    tens = sizes.groupBy("model", "field", F.ceil(F.col("len") / 10).alias("ten")).agg(
        F.sum("n").alias("n"), F.max("n").alias("top_n"), F.max_by("len", F.struct("n", "len")).alias("top")
    )
    total = tens.groupBy(F.col("model").alias("_m"), F.col("field").alias("_f")).agg(F.sum("n").alias("total"))
    one = (F.col("top_n") >= least_count) & (F.col("top_n") >= F.col("total") * F.lit(one_share)) & (F.col("top") >= least_length)
    whole = (F.col("n") >= least_count) & (F.col("n") >= F.col("total") * F.lit(ten_share)) & (F.col("ten") * 10 > least_length)
    return (
        tens.join(total, F.col("model").eqNullSafe(F.col("_m")) & (F.col("field") == F.col("_f")))
        .select("_m", "_f", F.col("ten").alias("_ten"), F.when(one, F.col("top")).alias("_top"), whole.alias("_all"))
        .where(F.col("_top").isNotNull() | F.col("_all"))
    )


def _facts(traces: DataFrame, *more: str) -> DataFrame:
    """(trace_id, model, h, size, at, f): of each delivery and field, ``at`` in FIELDS, what its value ends like. No shuffle."""
    raw = traces.select(
        "trace_id",
        "model",
        delivery_hash("model", *FIELDS, *more).alias("h"),
        sum(F.coalesce(F.length(f), F.lit(0)) for f in FIELDS).alias("size"),
        F.posexplode(F.array(*FIELDS)).alias("at", "raw"),
    )
    keys = ("trace_id", "model", "h", "size", "at")
    staged = raw.withColumn("text", _trimmed("raw"))
    text, para, line, last = F.col("text"), F.col("_para"), F.col("_line"), F.col("_last80")
    # a step each, so that no expression is repeated in the next; what only the end can hold is looked for there
    bare = F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, r"(?s)```.*?```", " ")).otherwise(text)
    staged = staged.withColumn("_para", F.substring_index(bare, "\n\n", -1)).withColumn("_line", F.substring_index(para, "\n", -1))
    staged = staged.withColumn("_last80", F.right(text, F.lit(80)))
    # the delimiters are looked for by single signs first: most ends hold none of a kind
    without = lambda where, what: F.length(F.replace(where, F.lit(what), F.lit("")))
    odd = lambda where, mark: F.contains(where, F.lit(mark)) & (F.pmod((F.length(where) - without(where, mark)) / len(mark), F.lit(2)) != 0)
    more_of = lambda where, a, b: F.contains(where, F.lit(a)) & (without(where, a) < without(where, b))
    inner = F.regexp_replace(para, r"(?m)^\s*\(?\w{1,3}\)", "")
    opened = (
        odd(text, "```")
        | odd(line, "**")
        | (odd(line, "`") & odd(para, "`"))
        | (odd(line, "$") & odd(para, "$"))
        | (odd(line, '"') & odd(para, '"'))
        | more_of(line, "\\[", "\\]")
        | more_of(line, "\\(", "\\)")
        | more_of(line, "{", "}")
        | (F.contains(para, F.lit("(")) & more_of(inner, "(", ")"))
        | more_of(para, "«", "»")
        | more_of(para, "「", "」")
        | F.when(F.contains(para, F.lit("„")), more_of(F.replace(para, F.lit("“"), F.lit("”")), "„", "”")).otherwise(more_of(para, "“", "”"))
    )
    has = F.coalesce(text.rlike(r"[a-zA-Z0-9\p{L}\p{N}]"), F.lit(False))
    told = staged.select(
        *keys,
        "text",
        F.length("raw").alias("len"),
        has.alias("held"),
        (has & last.rlike(CUT_MARK)).alias("mark"),
        (has & opened).alias("opened"),
        (has & ~last.rlike(SENTENCE_END) & ~line.rlike(LABEL_ONLY) & ~((F.length(text) < 40) & text.rlike(BARE))).alias("unsure"),
        (has & last.rlike(ANSWER_END)).alias("answered"),
    )
    # only the tail's tokens are needed for the last trigram
    told = told.withColumn("_toks", F.when(F.col("unsure") & ~F.col("mark") & ~F.col("opened"), _tokens(F.right("text", F.lit(200)))))
    told = told.withColumn("_t", F.try_element_at(_grams(F.col("_toks")), F.lit(-1)))
    context_key, gram_key = _keys("_t")
    asks = F.col("_t.t0").isNotNull()
    return told.select(
        *keys,
        F.struct(
            "len", "held", "mark", "opened", "answered", asks.alias("asks"), F.coalesce(F.col("_t.t0") == ".", F.lit(False)).alias("stop"), F.when(asks, context_key).alias("c"), F.when(asks, gram_key).alias("g")
        ).alias("f"),
    )


def deliveries(traces: DataFrame, *more: str) -> DataFrame:
    """(trace_id, h, copies, kinds, model, at, f): of each trace the delivery that counts, a row for each field.

    ``copies``: how often just this one was delivered; ``kinds``: how many different ones there are. ``more``: columns that
    tell deliveries apart besides model and texts. Equal rows are combined in each task before the shuffle.
    """
    counted = _facts(traces, *more).groupBy("trace_id", "at", "size", "h", "model", "f").agg(F.count("*").alias("copies"))
    best = counted.groupBy("trace_id", "at").agg(F.max(F.struct("size", "h", "copies", "model", "f")).alias("b"), F.count("*").alias("kinds"))
    return held(best.select("trace_id", "b.h", "b.copies", "kinds", "b.model", "at", "b.f"))


def _weighted(traces: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """(text, weight) of the values that count: one over the number of its copies for each of them. Texts aren't shuffled
    where the traces delivered more than once are at most ``SENT``."""
    again = chosen.where((F.col("at") == 0) & ((F.col("copies") > 1) | (F.col("kinds") > 1))).select(F.col("trace_id").alias("_id"), F.col("h").alias("_h"), "copies")
    if again.limit(SENT + 1).count() <= SENT:
        again = F.broadcast(again)
    rows = traces.select("trace_id", delivery_hash("model", *FIELDS, *more).alias("h"), *FIELDS).join(again, F.col("trace_id").eqNullSafe(F.col("_id")), "left")
    weight = F.when(F.col("copies").isNull(), 1.0).when(F.col("h") == F.col("_h"), 1.0 / F.col("copies")).otherwise(0.0)
    vals = rows.select(weight.alias("weight"), *FIELDS).where(F.col("weight") > 0).select("weight", F.explode(F.array(*FIELDS)).alias("raw"))
    return vals.select("weight", _trimmed("raw").alias("text"))


def judged(
    traces: DataFrame,
    *more: str,
    chosen: DataFrame | None = None,
    least_n: int = 5,
    word_ends: float = 0.10,
    stop_ends: float = 0.03,
    stop_n: int = 60,
    closed_n: int = 20,
    closed_new: float = 0.05,
    copied: int = 100,
) -> DataFrame:
    """(trace_id, model, field, reason): every value with the reason why it counts as cut, else null.

    Reasons, the first that holds: ``mark`` (left by the cut), ``open`` (delimiters left open), ``trigram``, ``limit``.
    ``chosen``: what ``deliveries`` gave with the same columns ``more``. ``copied``: equal texts of so many signs are copies.
    """
    chosen = deliveries(traces, *more) if chosen is None else chosen
    names = F.array(*map(F.lit, FIELDS))
    asked = chosen.select("trace_id", "model", F.get(names, F.col("at")).alias("field"), "f.*")
    exact, context = trigram_ends(_weighted(traces, chosen, *more))
    undecided = asked.where("asks").select("trace_id", "field", F.col("c").alias("_c"), F.col("g").alias("_g"))
    found = (
        undecided.join(exact.select(F.col("context").alias("_c"), F.col("gram").alias("_g"), F.col("n").alias("n3"), F.col("ends").alias("e3"), F.col("stops").alias("s3"), F.col("alone").alias("a3")), ["_c", "_g"])
        .join(context.select(F.col("context").alias("_c"), F.col("n").alias("n2"), F.col("ends").alias("e2"), F.col("stops").alias("s2"), F.col("alone").alias("a2")), "_c")
        .select(F.col("trace_id").alias("_id"), F.col("field").alias("_fd"), "n3", "e3", "s3", "a3", "n2", "e2", "s2", "a2")
    )
    at = limits(asked)
    got = asked.join(found, F.col("trace_id").eqNullSafe(F.col("_id")) & (F.col("field") == F.col("_fd")), "left").join(
        at, F.col("model").eqNullSafe(F.col("_m")) & (F.col("field") == F.col("_f")) & (F.ceil(F.col("len") / 10) == F.col("_ten")), "left"
    )
    at_limit = F.coalesce(F.col("_all") | (F.col("len") == F.col("_top")), F.lit(False))
    # the value's own end is left out of the figures
    n3, e3, s3 = (F.col(c) - 1 for c in ("n3", "e3", "s3"))
    # those of the trigrams that begin alike but end with another word
    n2, e2, s2 = (F.col(a) - F.col(b) for a, b in (("n2", "n3"), ("e2", "e3"), ("s2", "s3")))
    alone = F.col("a2") - F.when(F.col("a3"), F.col("n3")).otherwise(0)
    # it ends hardly anywhere but with values, which may be cut themselves, and is one of many
    untold = lambda least: (e3 - s3 <= n3 * F.lit(word_ends)) & (n3 * least <= n2)
    own = F.col("a3") & (F.col("len") >= copied)  # in no text but this one and its copies; short ones may be written twice
    cut = (
        F.when(F.col("stop"), (n3 >= stop_n) & (e3 < n3 * F.lit(stop_ends)))
        # where few words are those of one text and values seldom stop: a piece of a word
        .when(untold(closed_n) & (n2 >= closed_n) & (alone < n2 * F.lit(closed_new)) & (s2 < n2 * F.lit(word_ends)), F.lit(True))
        .when((n3 >= least_n) & ~own & ~(untold(least_n) & (n2 >= least_n)), e3 < n3 * F.lit(word_ends))
        .when(F.when(own, n2).otherwise(n2 + n3) >= least_n, F.when(own | untold(least_n), e2 < n2 * F.lit(word_ends)).otherwise(e2 + e3 < (n2 + n3) * F.lit(word_ends)))
        .otherwise(F.lit(True))
    )
    reason = (
        F.when(~F.col("held"), F.lit(None))
        .when(F.col("mark"), F.lit("mark"))
        .when(F.col("opened"), F.lit("open"))
        .when(F.col("asks") & ~F.col("answered") & cut, F.lit("trigram"))
        .when(F.col("asks") & ~F.col("answered") & ~F.col("stop") & at_limit, F.lit("limit"))
    )
    return got.select("trace_id", "model", "field", reason.alias("reason"))


def truncated(traces: DataFrame, *more: str, chosen: DataFrame | None = None) -> DataFrame:
    """(trace_id, model, field, reason) of the values that were cut."""
    return judged(traces, *more, chosen=chosen).where(F.col("reason").isNotNull()).select("trace_id", "model", "field", "reason")


def truncation_rates(traces: DataFrame) -> DataFrame:
    """(model, field, traces, cut, share): how often each model's values were cut, of its traces delivered."""
    return (
        judged(traces)
        .groupBy("model", "field")
        .agg(F.count("*").alias("traces"), F.count("reason").alias("cut"))
        .withColumn("share", F.col("cut") / F.col("traces"))
    )
