"""Queries of text functions, grading, openers and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import grading as g
from spanloom.functions import text as x
from spanloom.operators import pivots as pv
from spanloom.operators import sequences as seq
from spanloom.plans.tables import SP, TR, WS, spans, table, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def _inline(e: str) -> str:
    """DuckDB's expressions know no lookaround: two sentences that share a mark are told apart in two passes."""
    once = f"regexp_replace({e}, '([.!?])[{WS}]+([A-Z\\[\"])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({once}, chr(1)), lambda s: {_strip('s')}), lambda s: length(s) > 0)"


_MASKED = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(reasoning, ''), '\r\n?', chr(10), 'g'), '```[\s\S]*?```|`[^`\n]+`', ' [CODE] ', 'g'), '\$[^\$\n]{1,80}\$|\\\([^\)]{1,80}\\\)', ' [MATH] ', 'g')"""
_PARAS = f"list_filter(list_transform(regexp_split_to_array(masked, '\\n{{2,}}'), lambda p: {_strip('p')}), lambda p: length(p) > 0)"
_LINES = f"flatten(list_transform(string_split(p, chr(10)), lambda l: CASE WHEN length({_strip('l')}) >= 120 THEN {_inline(_strip('l'))} ELSE [{_strip('l')}] END))"
_SENT = f"""{TR}, mk AS (SELECT trace_id, dataset, {_MASKED} AS masked FROM tr),
pa AS (SELECT trace_id, dataset, {_PARAS} AS ps FROM mk),
ss AS (SELECT trace_id, dataset, list_filter(flatten(list_transform(ps, lambda p: CASE WHEN contains(p, chr(10)) THEN {_LINES} ELSE {_inline('p')} END)), lambda s: length(s) >= 4 AND s NOT IN ('[CODE]', '[MATH]')) AS ss FROM pa),
se AS (SELECT trace_id, dataset, i - 1 AS i, ss[i] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM ss)),
op AS (SELECT *, CASE WHEN regexp_matches(sentence, '^[{WS}]*\\p{{Lu}}') THEN array_to_string(list_slice(regexp_extract_all(lower(sentence), '[a-z'']+'), 1, 3), ' ') ELSE '' END AS ngram FROM se)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return pv.trace_sentences(traces(spark, d, "dataset", "reasoning"), "reasoning", "dataset")


@query(f"WITH {_SENT} SELECT trace_id, i, sentence FROM se")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("trace_id", "i", "sentence")


@query(f"WITH {_SENT} SELECT trace_id, i, ngram FROM op")
def sentence_openers(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("trace_id", "i", x.opener(F.col("sentence")).alias("ngram"))


_VOC = "tk AS (SELECT unnest(regexp_extract_all(lower(sentence), '[a-z'']+')) AS token FROM se), vo AS (SELECT token, count(*) AS n FROM tk GROUP BY 1 ORDER BY n DESC, token LIMIT 2000)"


@query(f"WITH {_SENT}, {_VOC} SELECT token, n FROM vo")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return pv.vocabulary(_sentences(spark, d), 2000)


_STATS = "st AS (SELECT ngram, count(*) AS freq, count(DISTINCT trace_id) AS traces, count(DISTINCT dataset) AS datasets FROM op WHERE ngram <> '' GROUP BY 1)"


@query(f"WITH {_SENT}, {_STATS} SELECT * FROM st")
def opener_stats(spark: SparkSession, d: str) -> DataFrame:
    return pv.opener_stats(_sentences(spark, d), 3)


_PIV = "pt AS (SELECT * FROM st ORDER BY freq DESC, ngram LIMIT 50000), pz AS (SELECT * FROM pt WHERE traces >= 5 AND datasets >= 3), pn AS (SELECT ngram, bool_and(coalesce(token IN (SELECT token FROM vo), false)) AS ok FROM (SELECT ngram, unnest(string_split(ngram, ' ')) AS token FROM pz) GROUP BY 1), pi AS (SELECT pz.* FROM pz JOIN pn USING (ngram) WHERE ok)"


def _pivots(s: DataFrame) -> DataFrame:
    return pv.pivots(pv.opener_stats(s, 3), pv.vocabulary(s, 2000), min_traces=5, min_datasets=3)


@query(f"WITH {_SENT}, {_VOC}, {_STATS}, {_PIV} SELECT * FROM pi")
def accepted_pivots(spark: SparkSession, d: str) -> DataFrame:
    return _pivots(_sentences(spark, d))


_SEG = f"""ln AS (SELECT op.*, pi.ngram IS NOT NULL AS hit, lag(sentence) OVER (PARTITION BY trace_id ORDER BY i) AS prev FROM op LEFT JOIN pi USING (ngram)),
bg AS (SELECT *, hit OR i = 0 OR regexp_matches(sentence, '^[{WS}]*(\\d+[.)][{WS}]+|[-•*][{WS}]+)') OR coalesce(ends_with(sentence, '?') AND prev IS NOT NULL AND NOT ends_with(prev, '?'), false) AS begins FROM ln),
sx AS (SELECT *, (sum(begins::INT) OVER (PARTITION BY trace_id ORDER BY i) - 1)::INT AS span_idx FROM bg),
sg AS (SELECT trace_id, span_idx, arg_min(sentence, i) AS anchor, (count(*) FILTER (NOT begins))::INT AS body_len, CASE WHEN arg_min(hit, i) THEN 'type_a' ELSE 'structural' END AS anchor_reason, arg_min(ngram, i) AS ngram,
  coalesce(array_to_string(list_slice(list(sentence ORDER BY i) FILTER (NOT begins), 1, 50), chr(10)), '') AS body FROM sx GROUP BY ALL)"""


@query(f"WITH {_SENT}, {_VOC}, {_STATS}, {_PIV}, {_SEG} SELECT * FROM sg")
def segmentation(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return pv.segment(s, _pivots(s), 3).withColumn("body", F.array_join("body", "\n"))


_CL = "cl AS (SELECT lower(ngram) AS ngram, min(cluster) AS cluster FROM sp WHERE cluster >= 0 AND ngram IS NOT NULL GROUP BY 1)"


@query(f"WITH {_SENT}, {_VOC}, {_STATS}, {_PIV}, {_SEG}, {SP}, {_CL} SELECT trace_id, span_idx, coalesce(cl.cluster, -1) AS cluster FROM sg LEFT JOIN cl USING (ngram)")
def labelled_spans(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    known = spans(spark, d, "cluster", "ngram").where("cluster >= 0 and ngram is not null").groupBy(F.lower("ngram").alias("ngram")).agg(F.min("cluster").alias("cluster"))
    return pv.label_spans(pv.segment(s, _pivots(s), 3), known).select("trace_id", "span_idx", "cluster")


@query(f"""WITH {SP}, c AS (SELECT cluster, dataset, count(*) AS n FROM sp WHERE cluster >= 0 GROUP BY ALL), t AS (SELECT cluster, sum(n) AS t, count(dataset) AS datasets FROM c GROUP BY 1), k AS (SELECT count(DISTINCT dataset) AS k FROM sp)
SELECT cluster, any_value(t)::BIGINT AS spans, any_value(datasets) AS datasets, round(CASE WHEN any_value(k) < 2 THEN 0.0::DOUBLE ELSE sum(-(n/t) * ln(n/t)) / ln(any_value(k)) END, 3) AS entropy FROM c JOIN t USING (cluster), k GROUP BY 1""")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return pv.cluster_stats(spans(spark, d, "cluster", "dataset"))


@query(f"WITH {SP}, c AS (SELECT cluster, ngram, count(*) AS n FROM sp WHERE cluster >= 0 AND ngram IS NOT NULL GROUP BY ALL) SELECT cluster, ngram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, ngram) AS rank FROM c) WHERE rank <= 25")
def top_openers(spark: SparkSession, d: str) -> DataFrame:
    c = spans(spark, d, "cluster", "ngram").where("cluster >= 0 and ngram is not null").groupBy("cluster", "ngram").agg(F.count("*").alias("n"))
    return pv.top_per_group(c, "cluster", "ngram", "n", 25)


_FALL = "coalesce(nullif(reasoning, ''), nullif(model_response, ''), '')"


@query(rf"""WITH {TR}, z AS (SELECT trace_id, {_FALL} AS t FROM tr), w AS (SELECT trace_id, t, list_filter(string_split_regex({_strip('t')}, '[{WS}]+'), lambda w: length(w) > 0) AS ws FROM z)
SELECT trace_id, length(t) AS chars, len(ws) AS words, round(ln(1 + length(t)), 9) AS log_length, round(len(regexp_extract_all(t, '(?i)\bwait\b')) / greatest(len(ws), 1), 9) AS wait_density,
 round(len(list_filter(ws, lambda w: contains(lower(w), 'again'))) / greatest(len(ws), 1), 9) AS again_share FROM w""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "reasoning", "model_response").select("trace_id", x.fallback_text(F.col("reasoning"), F.col("model_response")).alias("t"))
    c = F.col("t")
    return t.select(
        "trace_id", F.length(c).alias("chars"), F.size(x.words(c)).alias("words"), F.round(x.log_length(c), 9).alias("log_length"),
        F.round(x.word_density(c, r"\bwait\b"), 9).alias("wait_density"), F.round(x.containing_share(c, "again"), 9).alias("again_share"),
    )


@query(f"WITH {TR} SELECT trace_id, left(reasoning, greatest(1, length(reasoning) * 25 // 100)::INT) AS head, right(reasoning, 80) AS tail, left(reasoning, 1200) AS top FROM tr WHERE reasoning IS NOT NULL")
def text_cuts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("reasoning")
    return traces(spark, d, "reasoning").where(c.isNotNull()).select("trace_id", x.percent_prefix(c, 25).alias("head"), F.right(c, F.lit(80)).alias("tail"), F.left(c, F.lit(1200)).alias("top"))


_FULL = f"{_strip('''concat_ws(' ', anchor, array_to_string(body, ' '))''')}"


@query(rf"""WITH {SP}, z AS (SELECT trace_id, span_idx, anchor, {_FULL} AS full_text, {_strip("concat_ws(' ', anchor, body[1])")} AS head FROM sp),
y AS (SELECT *, regexp_extract(full_text, '^([\s\S]*?[.!?])[{WS}]', 1) AS cut, length(regexp_extract(head, '^([\s\S]*?)[.!?][{WS}]', 1)) AS cutpos, regexp_matches(head, '[.!?][{WS}]') AS has FROM z)
SELECT trace_id, span_idx, full_text, left(CASE WHEN cut = '' THEN full_text ELSE cut END, 200) AS topic, CASE WHEN has AND cutpos > 30 THEN left(head, (cutpos + 1)::INT) ELSE head END AS span_text FROM y""")
def span_texts(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("anchor"), F.col("body")
    return spans(spark, d, "anchor", "body").select("trace_id", "span_idx", x.full_text(a, b).alias("full_text"), x.topic_sentence(a, b, 200).alias("topic"), x.span_text(a, b).alias("span_text"))


_ALONE = r"regexp_extract_all(regexp_replace({c}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])({what})(?:$|[^\p{{L}}\p{{N}}_])', 1)"
_DIGITS = f"translate({{c}}, '{g.DIGITS}', '{'0123456789' * 4}')"


def _hit(c: str, pattern: str, at: int = 1, group: int = 1) -> str:
    return f"list_extract(regexp_extract_all({c}, '{pattern}', {group}), {at})"


def _plain(c: str) -> str:
    e = f"regexp_replace({_strip(c)}, '\\.+$', '')"
    for what, by in ((f"[{WS}$,%]", ""), (r"\\frac\{([^}]+)\}\{([^}]+)\}", r"\1/\2"), (r"\\[dt]frac\{([^}]+)\}\{([^}]+)\}", r"\1/\2"), (r"\\sqrt\{([^}]+)\}", r"sqrt(\1)"), (r"\\(text|mathrm|mathbf|textbf|left|right|big|Big)", ""), (r"\\[a-zA-Z]+", ""), ("[{}]", "")):
        e = f"regexp_replace({e}, '{what}', '{by}', 'g')"
    return f"lower({e})"


def _number(c: str) -> str:
    d = _DIGITS.format(c=c)
    return f"CASE WHEN regexp_full_match({d}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({d} AS DOUBLE) END"


@query(f"WITH z AS (SELECT DISTINCT gold_answer AS answer FROM final_dataset WHERE gold_answer IS NOT NULL) SELECT answer, {_plain('answer')} AS plain, ({_number('answer')}) IS NOT NULL AS is_number FROM z")
def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "final_dataset").where("gold_answer is not null").select(F.col("gold_answer").alias("answer")).distinct()
    return a.select("answer", g.plain_math(F.col("answer")).alias("plain"), g.as_number(F.col("answer")).isNotNull().alias("is_number"))


# the first or last match of each rule, in the rules' order
_RULES = [
    _hit("r", rf"(?i)(?:the answer is|the answer:)[{WS}]*\(?([A-J])\)?"), _hit("r", rf"(?i)answer[{WS}]*:[{WS}]*\$?\(?([A-J])\)?\$?"), _hit("r", rf"(?i)(?:choose|pick|select|choice)[{WS}]*:?[{WS}]*\(?([A-J])\)?"),
    _hit("r", r"\(([A-J])\)", -1), _hit("r", r"\*\*\(?([A-J])\)?\*\*"), f"list_extract({_ALONE.format(c='r', what='[A-J]')}, -1)",
]
_CHOICE = f"upper(coalesce({', '.join(_RULES)}))"
_FIELD = _strip(_hit("r", rf"(?i)answer[{WS}]*:[{WS}]*([^\n]+)"))
_BOXED = f"""CASE WHEN contains(r, '\\boxed{{') THEN {_strip("left(tail, (list_extract(list_filter(range(1, length(tail) + 1), lambda i: substr(tail, i, 1) = '}' AND len(regexp_extract_all(left(tail, i), '\\}')) = len(regexp_extract_all(left(tail, i), '\\{')) + 1), 1) - 1)::INT)")} END"""
_ANSWERS = f"""z AS (SELECT trace_id, dataset, model_response AS r, gold_answer AS gold, list_extract(string_split(model_response, '\\boxed{{'), -1) AS tail FROM tr),
y AS (SELECT *, {_CHOICE} AS choice, {_FIELD} AS stated, {_BOXED} AS boxed FROM z)"""


@query(f"WITH {TR}, {_ANSWERS} SELECT trace_id, choice, stated FROM y")
def answer_choice(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("model_response")
    return traces(spark, d, "model_response").select("trace_id", g.choice(r).alias("choice"), g.answer_field(r).alias("stated"))


@query(f"WITH {TR}, {_ANSWERS} SELECT trace_id, boxed FROM y")
def answer_boxed(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d, "model_response").select("trace_id", g.boxed(F.col("model_response")).alias("boxed"))


@query(rf"""WITH {TR}, z AS (SELECT trace_id, reasoning AS r FROM tr), y AS (SELECT trace_id, coalesce({_hit("r", rf"(?s)```python[{WS}]*?\n(.*?)```")}, {_hit("r", rf"(?s)```[{WS}]*?\n(.*?)```")}, {_hit("r", r"(?s)(?:^|\n)((?:def |class |import |from |if |for |while |    ).*)$")}) AS code FROM z) SELECT trace_id, {_strip("code")} AS code FROM y WHERE code IS NOT NULL""")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d, "reasoning").select("trace_id", g.code_block(F.col("reasoning")).alias("code")).where("code is not null")


#: How the tables' invented benchmarks are verified here, so that every kind is met.
_KIND = {"numera": "integer", "tidebench": "math", "codelore": "code", "gatewise": "choice", "scholarmix": "mixed", "polyscope": "phrase", "logicgrid": "grid", "proofline": "math"}
_EQ = lambda a, b: f"({_plain(a)} = {_plain(b)})"
_NEQ = lambda a, b: f"coalesce(abs(({_number(_plain(a))}) - ({_number(_plain(b))})) < 1e-6, false)"
_FIT = lambda e: f"CASE WHEN try_cast({_DIGITS.format(c=e)} AS HUGEINT) <= 999 THEN try_cast({_DIGITS.format(c=e)} AS INT) END"
_WHOLE = f"""coalesce({_FIT(_hit("boxed", r"\p{Nd}+", group=0))}, {_FIT(_hit("stated", r"\p{Nd}+", group=0))},
 {_FIT(_hit("r", rf"(?i)the answer is[{WS}]+(\p{{Nd}}{{1,3}})(?:$|[^\p{{L}}\p{{N}}_])"))}, {_FIT(f"list_extract({_ALONE.format(c='r', what=chr(92) + 'p{Nd}{1,3}')}, -1)")})"""
_LETTER = f"(choice = regexp_replace(upper({_strip('gold')}), '^[()]+|[()]+$', '', 'g'))"
_SAID = f"coalesce(stated, {_strip(f'list_extract(string_split({_strip(chr(114))}, chr(10)), -1)')})"
_TOLD = _strip(f"regexp_replace({_strip('coalesce(' + _strip(_hit('r', rf'(?i)(?:the answer is|the answer:|the final answer:)[{WS}]*([^' + chr(92) + r'n]+?)(?:' + chr(92) + r'.|' + chr(92) + 'n?$)')) + ', stated)')}, '^[()]+|[()]+$', '', 'g')")


@query(rf"""WITH {TR}, {_ANSWERS}, x AS (SELECT *, coalesce(boxed, stated, {_hit("r", r"-?\p{Nd}+(?:[.,]\p{Nd}+)*(?:/\p{Nd}+)?", -1, 0)}) AS math, {_WHOLE} AS whole, {_SAID} AS said, {_TOLD} AS told, {_strip('gold')} AS pure FROM y)
SELECT trace_id, dataset, whole, CASE WHEN dataset IN ('tidebench', 'proofline') THEN {_EQ("math", "gold")} OR {_NEQ("math", "gold")} WHEN dataset = 'gatewise' THEN {_LETTER}
 WHEN dataset = 'numera' THEN whole = try_cast(gold AS INT) WHEN dataset = 'scholarmix' THEN CASE WHEN regexp_full_match(pure, '[A-Z]') THEN {_LETTER} ELSE {_EQ("said", "gold")} OR (length(pure) > 2 AND contains(lower(said), lower(pure))) END
 WHEN dataset = 'polyscope' THEN CASE WHEN regexp_full_match(pure, '\(?[A-Z]\)?') AND regexp_full_match(upper(told), '\p{{L}}') THEN upper(told) = regexp_replace(pure, '[()]', '', 'g')
   WHEN lower(pure) IN ('yes', 'no', 'true', 'false', 'valid', 'invalid') THEN lower(told) = lower(pure) ELSE {_EQ("told", "gold")} END END AS graded FROM x""")
def graded_traces(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d, "dataset", "model_response", "gold_answer")
    r = F.col("model_response")
    kind = F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])[F.col("dataset")]
    return t.select("trace_id", "dataset", g.integer_answer(r).alias("whole"), g.verify(kind, r, F.col("gold_answer"), F.lit(None).cast("string")).alias("graded"))


_RELATIONS = ["Attribution", "Background", "Cause", "Comparison", "Condition", "Contrast", "Elaboration", "Enablement", "Evaluation", "Explanation", "Joint", "Manner-Means", "Summary", "Temporal", "Topic-Change", "Topic-Comment"]
_SAMPLE = ["Incorrect.", "CORRECT", "maybe", "3, 7", "x", "YES, it is", "no", '{"scope": "subproblem"}', "it is local.", "Manner-Means.", "I take Cause; or Contrast", "```python\nx = 1\n```"]
_REPLIES = "(VALUES " + ", ".join("('" + r.replace("\n", "' || chr(10) || '") + "')" for r in _SAMPLE) + ") AS t(reply)"


@query(rf"""SELECT reply, CASE WHEN contains(lower(reply), 'incorrect') THEN 0 WHEN contains(lower(reply), 'correct') THEN 1 END AS verdict,
 CASE WHEN len(regexp_extract_all(reply, '\d+')) >= 2 THEN array_to_string(list_transform(list_slice(regexp_extract_all(reply, '\d+'), 1, 2), lambda v: (v::INT - 1)::VARCHAR), ',') END AS labels,
 CASE WHEN starts_with(upper(trim(reply)), 'YES') THEN true WHEN starts_with(upper(trim(reply)), 'NO') THEN false END AS yes,
 CASE WHEN contains(reply, '"subproblem"') THEN 'SUB_PROBLEM' WHEN regexp_matches(reply, '(?i)\blocal\b') THEN 'LOCAL' ELSE 'UNCLEAR' END AS scope,
 list_extract(list_filter(list_transform(string_split_regex(reply, '[\s,;]+'), lambda w: regexp_replace(w, '[.,!?;:]+$', '')), lambda w: w IN ({", ".join(f"'{r}'" for r in _RELATIONS)})), 1) AS relation,
 CASE WHEN starts_with(reply, '```') THEN 'x = 1' ELSE reply END AS code FROM {_REPLIES}""")
def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(r,) for r in _SAMPLE], "reply string")
    c = F.col("reply")
    return t.select(
        "reply", g.verdict(c).alias("verdict"), F.array_join(g.two_labels(c).cast("array<string>"), ",").alias("labels"), g.yes_no(c).alias("yes"), g.scope(c).alias("scope"), g.relation(c, _RELATIONS).alias("relation"),
        g.without_fences(c).alias("code"),
    )


@query("""WITH o AS (SELECT problem_id, min(answer) AS a, min(subject) AS s, min(level) AS l FROM problems GROUP BY 1) SELECT problem_id, array_to_string(list_transform(list_filter([a, s, l], lambda v: v IS NOT NULL), lambda v, i: '(' || chr(64 + i::INT) || ') ' || v), chr(10)) AS options FROM o""")
def option_list(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("answer").alias("a"), F.min("subject").alias("s"), F.min("level").alias("l"))
    opts = F.array_compact(F.array("a", "s", "l"))
    return p.select("problem_id", F.array_join(F.transform(opts, lambda v, i: F.concat(F.lit("("), F.char(65 + i), F.lit(") "), v)), "\n").alias("options"))


@query("SELECT problem_id, category FROM (SELECT DISTINCT problem_id, category FROM problems) WHERE replace(lower(category), ' ', '_') IN ('a', 'b') AND category <> ''")
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").select("problem_id", "category").distinct()
    return p.where(F.replace(F.lower("category"), F.lit(" "), F.lit("_")).isin("a", "b") & (F.col("category") != ""))


@query("""WITH o AS (SELECT problem_id, min(answer) AS a, min(subject) AS s, min(level) AS l FROM problems GROUP BY 1), m AS (SELECT *, list_sort(list_transform(list_filter([a, s, l], lambda v: v IS NOT NULL), lambda v: {'h': md5(v || ':' || problem_id), 'o': v})) AS m FROM o)
SELECT problem_id, array_to_string(list_transform(m, lambda v: v.o), '|') AS options, chr((64 + list_position(list_transform(m, lambda v: v.o), a))::INT) AS letter FROM m""")
def option_shuffle(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("answer").alias("a"), F.min("subject").alias("s"), F.min("level").alias("l"))
    mixed = F.sort_array(F.transform(F.array_compact(F.array("a", "s", "l")), lambda o: F.struct(F.md5(F.concat_ws(":", o, "problem_id")).alias("h"), o.alias("o"))))["o"]
    return p.select("problem_id", F.array_join(mixed, "|").alias("options"), F.char(64 + F.array_position(mixed, F.col("a"))).alias("letter"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """(trace_id, k, op, start, length): of each trace the clusters of its anchored spans and where they begin in the text."""
    one = F.sort_array(F.collect_list(F.struct("span_idx", "anchor", "cluster")))
    s = spans(spark, d, "anchor", "cluster").where("anchor is not null").groupBy("trace_id").agg(one.alias("s"))
    t = traces(spark, d, "reasoning").join(s, "trace_id")
    at = t.select("trace_id", F.length("reasoning").alias("length"), F.col("s.cluster").alias("ops"), x.locate_forward(F.col("reasoning"), F.col("s.anchor")).alias("at"))
    return at.select("trace_id", "length", F.posexplode(F.arrays_zip("ops", "at")).alias("k", "z")).select("trace_id", "k", F.col("z.ops").alias("op"), F.col("z.at").alias("start"), "length")


_PLACES = f"""an AS (SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY span_idx) - 1)::INT AS k, {_strip("anchor")} AS a, cluster FROM sp WHERE anchor IS NOT NULL),
pl AS (SELECT trace_id, -1 AS k, 0 AS cur, NULL::INT AS start FROM tr UNION ALL
  SELECT p.trace_id, an.k, CASE WHEN h.hit > 0 THEN (p.cur + h.hit - 1 + length(an.a))::INT ELSE p.cur END, CASE WHEN h.hit > 0 THEN (p.cur + h.hit - 1)::INT END
  FROM pl p JOIN an ON an.trace_id = p.trace_id AND an.k = p.k + 1 JOIN tr ON tr.trace_id = p.trace_id, LATERAL (SELECT CASE WHEN an.a = '' THEN 0 WHEN strpos(substr(tr.reasoning, p.cur + 1), an.a) > 0 THEN strpos(substr(tr.reasoning, p.cur + 1), an.a) ELSE strpos(substr(tr.reasoning, p.cur + 1), left(an.a, 60)) END AS hit) h)"""


@query(f"WITH RECURSIVE {TR}, {SP}, {_PLACES} SELECT trace_id, k, start FROM pl WHERE k >= 0")
def anchor_places(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("trace_id", "k", "start")


_REGIONS = f"{_PLACES}, re AS (SELECT p.trace_id, p.k, p.start, coalesce((SELECT min(q.start) FROM pl q JOIN an b ON b.trace_id = q.trace_id AND b.k = q.k WHERE q.trace_id = p.trace_id AND q.k > p.k AND b.cluster IS NOT DISTINCT FROM an.cluster AND q.start IS NOT NULL), length(tr.reasoning))::INT AS stop FROM pl p JOIN an ON an.trace_id = p.trace_id AND an.k = p.k JOIN tr ON tr.trace_id = p.trace_id WHERE p.start IS NOT NULL)"


@query(f"WITH RECURSIVE {TR}, {SP}, {_REGIONS} SELECT trace_id, k, start, stop FROM re")
def operator_regions(spark: SparkSession, d: str) -> DataFrame:
    return seq.regions(_placed(spark, d))


@query(f"WITH RECURSIVE {TR}, {SP}, {_REGIONS}, f AS (SELECT trace_id, arg_min(start, k) AS a, arg_min(stop, k) AS b FROM re GROUP BY 1) SELECT trace_id, left(reasoning, a) || '<<' || substr(reasoning, a + 1, b - a) || '>>' || substr(reasoning, b + 1) AS marked FROM f JOIN tr USING (trace_id)")
def marked_regions(spark: SparkSession, d: str) -> DataFrame:
    r = seq.regions(_placed(spark, d)).groupBy("trace_id").agg(F.min(F.struct("k", "start", "stop")).alias("r"))
    return traces(spark, d, "reasoning").join(r, "trace_id").select("trace_id", x.mark_region(F.col("reasoning"), F.col("r.start"), F.col("r.stop")).alias("marked"))


@query(f"WITH {TR} SELECT DISTINCT upper(left(model, 1)) || substr(replace(model, '-', ' '), 2) AS shown, model FROM tr")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    m = traces(spark, d, "model").select("model").distinct()
    names = m.select(F.col("model").alias("_m"), F.concat(F.upper(F.left("model", F.lit(1))), F.substr(F.replace("model", F.lit("-"), F.lit(" ")), F.lit(2))).alias("shown"))
    return m.join(names, F.col("model") == F.col("_m"), "left").select("model", F.coalesce("shown", "model").alias("shown"))
