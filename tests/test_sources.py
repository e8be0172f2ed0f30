"""Reading, writing, resuming, judging and streaming, round trip."""

import gzip
import json

import pytest

from spanloom.sources import jsonl, judge
from spanloom.streaming.traces import sentence_stream, store_traces

SCHEMA = "trace_id string, model string, dataset string, reasoning string, v int"


def test_round_trip(spark, tmp_path):
    rows = [("a", "m", "d", "x\ny", 1), ("b", None, "d", "é", None)]
    jsonl.write_jsonl(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "o"))
    assert sorted(map(tuple, jsonl.read_strict(spark, str(tmp_path / "o"), SCHEMA).collect())) == rows


def test_bad_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write('{"trace_id": "a", "v": 1}\n\n{bad\n{"trace_id": "a", "v": 2}\n')
    rows, bad = jsonl.read_tolerant(spark, str(p), "trace_id string, v int")
    assert sorted(r.v for r in rows.collect()) == [1, 2] and bad.count() == 1
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), "trace_id string, v int").collect()


def test_keyed_tree_dimension(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"trace_id":"a","v":1}\n{"trace_id":"a","v":3}\n{"trace_id":"a","v":2}\n')
    assert [tuple(r) for r in jsonl.read_keyed(spark, str(tmp_path / "k.jsonl"), "trace_id string, v int", "trace_id", ["v"]).collect()] == [("a", 3)]
    d = tmp_path / "t/sample_2/mo/da"
    d.mkdir(parents=True)
    (d / "p.json").write_text(json.dumps({"problem_id": "p"}))
    (d / "_s.json").write_text("{}")
    (d / "q.json").write_text("{bad")
    got = jsonl.read_tree(spark, str(tmp_path / "t"), "problem_id string").collect()
    assert [(r.problem_id, r["sample"], r.model, r.dataset) for r in got] == [("p", 2, "mo", "da")]
    (tmp_path / "n.json").write_text('{"0": {"name": "A", "description": null}}')
    assert [tuple(r) for r in jsonl.read_dimension(spark, str(tmp_path / "n.json")).collect()] == [("0", "A", None)]


def test_append_new(spark, tmp_path):
    p = str(tmp_path / "a")
    jsonl.append_new(spark.createDataFrame([("a", 1)], "trace_id string, v int"), p)
    again = spark.createDataFrame([("a", 9), ("b", 2)], "trace_id string, v int")
    assert sorted(map(tuple, jsonl.append_new(again, p).collect())) == [("a", 1), ("b", 2)]


def test_judge(spark):
    class Flaky:
        n = 0

        def ask(self, prompt):
            Flaky.n += 1
            if "bad" in prompt:
                raise ValueError("no")
            return prompt.upper()

    df = spark.createDataFrame([("1", "x"), ("2", "bad"), ("3", None)], "k string, p string")
    got = {r.k: (r.reply, r.error) for r in judge.ask(df, "k", "p", Flaky, tries=2, wait=0.0).collect()}
    assert got == {"1": ("X", None), "2": (None, "ValueError: no"), "3": (None, "no prompt")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"trace_id":"a","reasoning":"One it is. Two it is."}\n{"trace_id":"a","reasoning":"One it is."}\n')
    stream = sentence_stream(spark, str(tmp_path / "in"), SCHEMA)
    assert stream.isStreaming and "ngram" in stream.columns
    rows = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    for _ in range(2):
        store_traces(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    store_traces(stream, str(tmp_path / "s"), str(tmp_path / "d"), ("trace_id", "i")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2  # both sentences of the trace, once


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", [1, 2], None)], "x string, y array<int>, z int")
    jsonl.write_table(df, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "t"), header=True, escape='"').collect()] == [("a,b", "[1,2]", None)]


def test_benchmarks(spark):
    from spanloom.sources import benchmarks as b

    def rows(name, raw, **more):
        return [(r.problem_id, r.problem, r.answer) for r in b.problems(name, raw, **more).orderBy("problem_id").collect()]

    one = lambda values, schema: spark.createDataFrame([values], schema)
    assert rows("math", one(("u/1", "Q", "4"), "unique_id string, problem string, answer string")) == [("u/1", "Q", "4")]
    assert rows("aime", one((7, "Q", 204), "row int, problem string, answer int")) == [("aime_007", "Q", "204")]
    four = one((3, "Q?", "r", "a", "b", "c"), "row int, Question string, `Correct Answer` string, `Incorrect Answer 1` string, `Incorrect Answer 2` string, `Incorrect Answer 3` string")
    (key, text, letter), = rows("gpqa", four)
    assert key == "gpqa_0003" and text.startswith("Q?\n\n(A) ") and f"({letter}) r" in text and len(text.split("\n")) == 6
    assert rows("livecodebench", one((1, "Q", None), "row int, question_content string, question_id string")) == [("lcb_0001", "Q", "")]
    assert b.problems("livecodebench", one((1, "Q", [("1", "2")]), "row int, question_content string, public_test_cases array<struct<input:string,output:string>>")).first().test_cases == '[{"input":"1","output":"2"}]'
    assert b.problems("hle", one((1, "Q", "A", "multiple_choice"), "row int, question string, answer string, answer_type string")).first().answer_type == "multiple_choice"
    many = spark.createDataFrame([(1, "Q", ["x", "y"], "B", "Political Science"), (2, "Q", ["x"], "A", "math"), (3, "Q", [], "A", "law"), (4, "Q", None, "A", None)], "row int, question string, options array<string>, answer string, category string")
    assert rows("mmlu_pro", many) == [("mmlu_pro_00001", "Q\n\n(A) x\n(B) y", "B")]
    assert rows("arc_challenge", one((2, "Q", (["1", "2"], ["x", "y"]), "2"), "row int, question string, choices struct<label:array<string>,text:array<string>>, answerKey string")) == [("arc_0002", "Q\n\n(1) x\n(2) y", "2")]
    assert rows("bbh", one((0, "snarks", "Q", "(A)"), "row int, task string, input string, target string")) == [("bbh_snarks_000", "Q", "(A)")]
    assert rows("humaneval", one(("H/0", "def f():", "t", "f"), "task_id string, prompt string, test string, entry_point string")) == [("H/0", "def f():", "")]
    grid = one(("ab", [([[1, 2]], [[3]])], [([[4]], [[5, 6]])]), "name string, train array<struct<input:array<array<int>>,output:array<array<int>>>>, test array<struct<input:array<array<int>>,output:array<array<int>>>>")
    assert rows("arc_agi2", grid) == [("arc_agi2_ab_0", "Example 1:\nInput: [[1, 2]]\nOutput: [[3]]\n\nTest input: [[4]]", "[[5, 6]]")]
    assert len(rows("math", spark.createDataFrame([(f"u{k}", "Q", "1") for k in range(9)], "unique_id string, problem string, answer string"), n=4)) == 4
    with pytest.raises(ValueError):
        b.problems("unknown", many)


def test_registry():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
