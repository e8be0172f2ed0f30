"""Term frequency, runs and patterns against plain Python, with nulls, empties, repeats and extra columns."""

import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from spanloom.llm.patterns import event_sequences, frequent_patterns, mine_batch
from spanloom.llm.runs import collapse_runs, sequence_events
from spanloom.llm.terms import corpus_terms

NAMES = [(0, "OPEN", None), (1, "DOUBT", None), (2, "De-duce", None), (7, "deduce ", None), (8, None, None), (9, "--", None)]
TRACE = "trace_id string, model string, operator_sequence array<int>, span_start_ms array<bigint>, trace_end_ms bigint, reasoning string, n long"


def names(spark):
    return spark.createDataFrame(NAMES, "cluster int, name string, description string")


def test_runs(spark):
    rows = [
        ("a", "m", [0, 0, -1, 0, 2, 7, 1], [0, 10, 15, 20, 30, 45, 60], 100, "", 1),
        ("a", "m", [0, 0, -1, 0, 2, 7, 1], [0, 10, 15, 20, 30, 45, 60], 100, "", 1),
        ("b", "m", None, None, None, None, 1),
        ("c", None, [], [], 5, "", 1),
        ("d", "m", [-1, 8, 9, 9, None, 9], None, 7, "", 1),
        (None, "m", [1], [3], 9, "", 1),
    ]
    df = spark.createDataFrame(rows, TRACE)
    got = {(r.trace_id, r.op, r.start_idx, r.end_idx, r.n, r.duration_ms) for r in collapse_runs(sequence_events(df, names(spark))).collect()}
    assert got == {
        ("a", 0, 0, 3, 3, 30), ("a", 2, 4, 5, 2, 30), ("a", 1, 6, 6, 1, 40), ("d", 8, 1, 1, 1, None), ("d", 9, 2, 5, 3, None), (None, 1, 0, 0, 1, 6),
    }
    assert {r.start_idx for r in collapse_runs(sequence_events(df, names(spark)), min_count=2).where("trace_id = 'a'").collect()} == {0, 4}
    assert collapse_runs(sequence_events(df.limit(0), names(spark))).count() == 0


def holds(seq, pattern, gap=2):
    def at(k, pos):
        return k == len(pattern) or any(seq[j] == pattern[k] and at(k + 1, j) for j in range(pos + 1, min(pos + 2 + gap, len(seq))))

    return any(seq[i] == pattern[0] and at(1, i) for i in range(len(seq)))


def test_patterns_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"t{i}", rnd.choice(["x", "y", None]), [rnd.choice([0, 1, 2, 7, -1]) for _ in range(rnd.choice([0, 3, 9, 70]))], None, None, None, 1) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], TRACE)
    got = {(r.model, r.pattern): (r.support, r.total) for r in frequent_patterns(event_sequences(df, names(spark)), min_support=2, min_share=0.3).collect()}
    seqs = {}
    for _, m, s, *_ in rows:
        s = [2 if x == 7 else x for x in s if x != -1]
        if s:
            seqs.setdefault(m, []).append(s)
    want = {}
    for m, own in seqs.items():
        for n in (4, 5):
            for code in range(3**n):
                p = [code // 3**k % 3 for k in range(n)]
                c = sum(holds(s, p) for s in own)
                if c >= 2 and c >= 0.3 * len(own):
                    want[m, ">".join(map(str, p))] = (c, len(own))
    assert got == want
    assert frequent_patterns(event_sequences(df.limit(0), None)).count() == 0


def test_bits_cross_words():
    import numpy as np

    seq = [0] * 62 + [1, 2, 3, 4] + [0] * 70
    found = {p: int(c[0]) for p, c in mine_batch(np.array(seq), np.array([len(seq)]), np.array([0]), 1, 4, 4, 0)}
    assert found[(1, 2, 3, 4)] == 1 and (4, 3, 2, 1) not in found


def test_terms_brute_force(spark):
    rnd = random.Random(1)
    bank = ["the", "Don’t", "wait", "été", "''", "x1y", "THE", "K", "naïve", " ", "rare" + "z"]
    traces = [(f"t{i}", "m", None, None, None, " ".join(rnd.choice(bank) for _ in range(rnd.randint(0, 12))) if i % 9 else None, 1) for i in range(40)]
    traces += traces[:6]
    spans = [(f"t{rnd.randint(0, 20)}", rnd.randint(0, 30), None) for _ in range(80)]
    spans = {(a, b): (a, b, rnd.choice([None, "", " ", "We  are given", "we are given", "It’s so", "x" * 50])) for a, b, _ in spans}
    span_rows = list(spans.values()) * 2
    t = spark.createDataFrame(traces, TRACE)
    s = spark.createDataFrame(span_rows, "trace_id string, span_idx int, ngram string").withColumn("term", F.lit("clash"))
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in corpus_terms(t, s, common_ngram=0.3).collect()}
    recs = {"ngram": {}, "reasoning": {}}
    for a, _, g in spans.values():
        w = re.sub(r"\s+", " ", (g or "").lower().replace("’", "'")).strip()
        if w:
            recs["ngram"].setdefault(a, Counter())[w] += 1
    for a, _, _, _, _, x, _ in {r[0]: r for r in traces}.values():
        for w in re.findall(r"[a-z']+", (x or "").lower().replace("’", "'")):
            if w.strip("'"):
                recs["reasoning"].setdefault(a, Counter())[w] += 1
    want = {}
    for f, share in (("ngram", 0.3), ("reasoning", 0.4)):
        total = len(recs[f])
        for term in {w for c in recs[f].values() for w in c}:
            n, k = sum(c[term] for c in recs[f].values()), sum(term in c for c in recs[f].values())
            want[f, term] = (n, k, "rare" if k < 3 else "common" if k > share * total else None)
    assert got == want
    assert corpus_terms(t.limit(0), s.limit(0)).count() == 0
    assert list(combinations([1, 2], 2))


def test_batches_that_fit():
    import numpy as np

    from spanloom.llm.patterns import fitting

    part = [(0, np.arange(k, k + 40)) for k in range(50)]
    pieces = list(fitting(part, most=200))
    assert [s[0] for p in pieces for _, s in p] == list(range(50)) and len(pieces) > 10 and list(fitting(part)) == [part]
