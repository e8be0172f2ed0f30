import random

from spanloom.llm.pairs import defects, is_refusal, language, pair_defects
from spanloom.llm.truncation import judged, truncated, truncation_rates

SCHEMA = "trace_id string, model string, problem string, reasoning string, model_response string, at_limit int"
NOUNS = "queue tiling marble corner lantern ledger schedule digit orbit prefix".split()


def corpus():
    rnd = random.Random(4)
    line = lambda: rnd.choice(["The {a} can't be larger than the {b}.", "We need the {a} to be sorted and below the {b}.", "Let me start with the {a} and write down the {b}."]).format(a=rnd.choice(NOUNS), b=rnd.choice(NOUNS))
    return [(f"t{i}", "m", "What is it?", "\n".join(line() for _ in range(6)), "Answer: 4", 1) for i in range(150)]


CUT = {
    "c1": "The queue can't be larger than the",
    "c2": "We need the tiling to be sor",
    "c3": "The queue can't be larg…",
    "c4": "Let me start. The note (see the",
    "c5": "```py\nx = 1",
    "c6": "The marble can't be larger than �",
}
WHOLE = {"w1": "The queue can't be larger than the tiling", "w2": "\\[ x = 1 \\]", "w3": "320", "w4": "", "w5": None, "w6": "- corner 3x + 4\n- **Step 2**", "w7": "Answer:", "w8": "   ", "w9": "Final answer: **4**"}


def test_truncated(spark):
    rows = corpus() + [(k, "m", None, v, None, 1) for k, v in {**CUT, **WHOLE}.items()]
    rows += rows[-20:]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.trace_id for r in truncated(df).where("field = 'reasoning'").collect()}
    assert got == set(CUT)
    rates = {r.field: (r.traces, r.cut) for r in truncation_rates(df).collect()}
    assert rates["reasoning"] == (165, 6) and rates["model_response"] == (165, 0)
    assert truncated(df.limit(0)).count() == 0


def test_defects():
    q = "Two even clerks, Ana and Bo, share 187 stamps. How many remain at the end of the day?"
    for a in (None, "", " \n", "\u200b", "N/A", "Answer:", "**Answer:**", "\\boxed{}", "<answer></answer>", "```\n```", "...", "-", "null"):
        assert defects(q, a) == ["empty"], a
    for a in ("I'm sorry, but I can't help with this request.", "Dabei kann ich nicht helfen.", "抱歉，我无法回答这个问题。", "Lo siento, pero no puedo ayudar con esta petición.", "Извините, я не могу помочь с этим."):
        assert defects(q, a) == ["refusal"], a
    for a in (q, q.upper(), "Problem: " + q, "How many remain at the end of the day? Two even clerks, Ana and Bo, share 187 stamps.", q.replace("share", "shaer") + " " + q):
        assert defects(q, a) == ["copy"], a
    for a in ("320", "\\boxed{D}", "I'm sorry for the slip above; the answer is 4.", "Unfortunately, the first one won't help. Answer: 4", q + " Answer: 93", "D", "n = 4"):
        assert defects(q, a) == [], a
    assert defects(q, "Nein, ich muss die Kante noch einmal berechnen und die Zahl ist dann genau 4.") == ["other_language"]
    assert defects(None, "Nein, ich muss die Kante noch einmal berechnen.") == [] == defects("  ", "x y z")
    assert language("x = 4") is None and language("所以边界正好等于351。") == "zh" and language("行列は60と82の間にあります。") == "ja"


def test_pairs(spark):
    df = spark.createDataFrame([("a", "m", "Q one?", None, "ok it is 4.", 1), ("a", "m", "Q one?", None, "ok it is 4.", 1), ("b", "m", None, "x", "", 1)], SCHEMA)
    assert sorted((r.trace_id, r.field, r.defect) for r in pair_defects(df).collect()) == [("a", "reasoning", "empty"), ("b", "model_response", "empty")]
    assert pair_defects(df.limit(0)).count() == 0


def test_long_refusals():
    q = "Two even clerks, Ana and Bo, share 187 stamps. They give 3 + 4 of them away. How many remain at the end of the day?"
    why = "The people who wrote the rules wanted every reader to ask a teacher about matters like these, and a teacher knows more about them. "
    no = "I'm sorry, but I can't help with this request. "
    for a in (no + why * 12, why * 12 + no, "I'm sorry that you had to wait. You asked this: " + q * 6 + " " + no + why * 12, "Let me read it again. We have n = 4 rows. " * 30 + no):
        assert len(a) > 600 and is_refusal(a, q) and "refusal" in defects(q, a)
    assert is_refusal(("Das ist eine lange Erklärung der Regeln. " * 30) + "Dabei kann ich leider nicht helfen.")
    # an aside is none, nor is a text with an answer
    for a in ("We look at the rows. " * 20 + "I can't solve this directly. " + "So let n = 4 and go on with it. " * 20, no + why * 12 + "The answer is 4."):
        assert not is_refusal(a, q) and "refusal" not in defects(q, a)


def test_every_defect(spark):
    q = "Two even clerks, Ana and Bo, share 187 stamps. How many remain at the end of the day?"
    no = "Dabei kann ich leider nicht helfen, weil die Regeln das nicht erlauben."
    df = spark.createDataFrame([("a", "m", q, no, q + " I refuse.", 1), ("b", "m", None, no, "4", 1)], SCHEMA)
    got = sorted((r.trace_id, r.field, r.defect) for r in pair_defects(df).where("defect != 'truncated'").collect())
    assert got == [("a", "model_response", "copy"), ("a", "model_response", "refusal"), ("a", "reasoning", "other_language"), ("a", "reasoning", "refusal"), ("b", "reasoning", "refusal")]


def test_delimiters_far_from_the_end(spark):
    far = "so it is and " * 150
    whole = {"w1": "Code:\n```py\n" + "x = 1\n" * 400 + "```", "w2": 'It says "' + far + 'that" is it!', "w3": "Code:\n```sh\n" + "echo `pwd`\n" * 200 + "```", "w4": "We see $" + far + "$ here!"}
    cut = {"c1": "We see (" + far + "that is it!", "c2": "We see «" + far + "that is it!", "c3": "We see \\(" + far + "that is it!"}
    df = spark.createDataFrame([(k, "m", None, v, None, 1) for k, v in {**whole, **cut}.items()], SCHEMA)
    got = {r.trace_id: r.reason for r in judged(df).where("field = 'reasoning'").collect()}
    assert got == {**dict.fromkeys(whole), **dict.fromkeys(cut, "open")}


def test_long_copies_and_empty_values():
    q = "Two even clerks, Ana and Bo, share 187 stamps. How many remain at the end of the day?"
    other = "They count on, row by row, until some clerk of the office finds that no stamp was lost and nobody has to pay for it. "
    assert defects(q, (q + "\n") * 20) == ["copy"] == defects(q, "Question: " + (q.upper() + " ") * 30) and defects(q, q + other * 30) == []
    for a in ("Answer:" + " " * 400, "Answer:" + "\u200b" * 400, "<answer></answer>\n" * 40, "**Answer:**\n" * 40, "\\boxed{}" * 60, "N/A" + "\n" * 300, "```text\n" + " " * 300 + "\n```"):
        assert len(a) > 200 and defects(q, a) == ["empty"], a
    assert defects(q, "Answer:" + " " * 400 + "4") == [] == defects(q, "Answer: " * 40 + "n")


def test_one_delivery_decides(spark, monkeypatch):
    q = "Two even clerks, Ana and Bo, share 187 stamps. How many remain at the end of the day?"
    no = "I'm sorry, but I can't help with this request."
    rows = [("a", "m", q, no, "4", 1), ("a", "m", q, None, "4", 1), (None, "m", q, "", "4", 1), (None, "m", q, "", "4", 1)]
    got = sorted((r.trace_id or "", r.field, r.defect) for r in pair_defects(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("", "reasoning", "empty"), ("a", "reasoning", "refusal")]
    # a trace with a third of all rows counts once, whether its id is sent to the tasks or joined
    rows = corpus() + [(k, "m", None, v, None, 1) for k, v in {**CUT, **WHOLE}.items()]
    df = spark.createDataFrame(rows + [rows[3]] * 80 + [("t3", "m", None, "Short", None, 1)], SCHEMA)
    sent = sorted(map(tuple, judged(df).select("trace_id", "field", "reason").collect()))
    monkeypatch.setattr("spanloom.llm.truncation.SENT", 0)
    assert sent == sorted(map(tuple, judged(df).select("trace_id", "field", "reason").collect()))
    assert {k for k, f, r in sent if r} == set(CUT)


def test_pieces_that_recur(spark):
    """As in large tables: the same piece at the end of many texts, or of a text repeated under other keys."""
    piece = "{} We need the tiling to be sor"
    many = [(f"p{i}", "m", None, piece.format("We look at " + "ab"[i % 2] * (i + 2) + " rows!"), None, 1) for i in range(12)]
    far = "It is so. " * 12
    copies = [(f"q{i}", "m", None, far + "The zirc of the lantern zulo", None, 1) for i in range(12)] + [(f"r{i}", "m", None, far + "We need the corner to be bel", None, 1) for i in range(12)]
    whole = [(f"w{i}", "m", None, "The queue can't be larger than the tiling", None, 1) for i in range(12)]
    df = spark.createDataFrame(corpus() + many + copies + whole, SCHEMA)
    got = {r.trace_id for r in truncated(df).where("reason = 'trigram'").collect()}
    alone = {r.trace_id for r in truncated(spark.createDataFrame(corpus() + many[:1] + copies[:1] + copies[12:13] + whole[:1], SCHEMA)).where("reason = 'trigram'").collect()}
    assert alone == {"p0", "q0", "r0"}
    assert got == {r[0] for r in many + copies}
