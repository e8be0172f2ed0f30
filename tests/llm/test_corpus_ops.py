"""Leaks against brute force, languages by held-out accuracy, mixtures by their sums."""

import random

import pytest

from spanloom.llm.langid import document_languages, fit_model, relabelled
from spanloom.llm.leakage import leaked_items, leaks, plain, sign_tokens, suffix_array, without_leaks, word_tokens
from spanloom.llm.mixing import budgets, count_tokens, fill, mixture, mixture_shares, source_budgets

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_suffix_array():
    import numpy as np

    rnd = random.Random(1)
    for n in (1, 2, 7, 60):
        t = [rnd.randrange(3) for _ in range(n)]
        assert list(suffix_array(np.array(t))) == sorted(range(n), key=lambda i: t[i:])
    assert list(suffix_array(np.zeros(40, dtype=int))) == list(range(39, -1, -1))


def test_plain():
    known = {"invariant": 1}
    assert word_tokens(plain("<p>The&nbsp;**inva-\nriant** of “Émile”, ９８</p>"), known) == ["the", "invariant", "of", "emile", "98"]
    assert sign_tokens(plain("第3天，\n又丢")) == list("第3天又丢")


def test_leaks_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(8)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(18)), "en", "s") for i in range(4)] + [(9, "短", "zh", None), (10, None, "en", None), (11, "甲乙丙丁" * 8, "zh", "s")]
    docs = []
    for k in range(60):
        words = [rnd.choice([*vocab, "zz"]) for _ in range(30)]
        if k % 3 == 0:
            src = items[k % 4][1].split()
            a = rnd.randint(0, 8)
            words[5:5] = src[a : a + rnd.randint(9, 18)]
        docs.append((k, " ".join(words).upper(), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "甲乙丙丁" * 8, "x"), (103, items[0][1], "x"), (103, items[0][1], "x")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, matched string"), spark.createDataFrame(items, "item_id long, text string, lang string, suite string")
    got = {(r.doc_id, r.item_id): r.matched for r in leaks(d, i, least_words=12, block_chars=80, shard_tokens=200).collect()}
    want = {}
    for doc, text, _ in docs:
        for item, t, lang, _ in items:
            a, b = ((text or "").lower().split(), (t or "").split()) if lang == "en" else (list(text or ""), list(t or ""))
            best = max((n for p in range(len(a)) for q in range(len(b)) for n in [next((m for m in range(len(b) + 1) if p + m >= len(a) or q + m >= len(b) or a[p + m] != b[q + m]), 0)]), default=0)
            if best >= (12 if lang == "en" else 24):
                want[doc, item] = best
    assert got == want and (102, 11) in got and len(got) > 5
    found = leaks(d, i)
    assert {r.item_id: r.documents for r in leaked_items(found, i).collect()}[9] == 0
    assert without_leaks(d, found).where("doc_id = 102").count() == 0
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_shared_header(spark, monkeypatch):
    import numpy as np

    from spanloom.llm.leakage import Queries, Shard

    header = [f"h{k}" for k in range(40)]
    q = Queries(list(range(100, 150)), [header + [f"i{n}_{k}" for k in range(20)] for n in range(50)], 12)
    assert sum(len(i) for i, _, _ in q.heads(300)) == 50 * 49 and max(len(h) for _, _, h in q.heads(300)) <= 300
    shard = Shard(q)
    for doc in range(80):
        shard.add(doc, ["x"] * 5 + header + ["y"])
    pieces = list(shard.matches(most=9000))
    assert len(pieces) > 10 and max(len(p[0]) for p in pieces) <= 9000 // 29
    d, i, n, o, p = (np.concatenate(x) for x in zip(*pieces))
    assert len(set(zip(d.tolist(), i.tolist()))) == len(d) == 80 * 50 and set(n) == {40} and set(o) == {0} and set(p) == {5}
    ja = "この表の各行の数を数えると答えは全部で四十二個になることが分かります"
    items = spark.createDataFrame([(1, ja, "ja", None), (1, ja, "ja", None), (2, " ".join(header), "en", None)], "item_id long, text string, lang string, suite string")
    docs = spark.createDataFrame([(1, "x " + ja + "。", 0), (2, " ".join(header), 0), (None, "x", 0)], "doc_id long, text string, matched int")
    for block in (40, 8_000_000):
        assert sorted((r.doc_id, r.item_id, r.unit) for r in leaks(docs, items, block_chars=block).collect()) == [(1, 1, "sign"), (2, 2, "word")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS.replace("0.001", "0.01"))


def test_languages(spark, docs):
    model = fit_model(docs, per_language=25)
    held = {"de": "Wir wissen nicht, ob die Straße heute noch frei ist.", "zh": "我们今天去公园散步。", "ja": "今日は公園を散歩します。", "ru": "Мы не знаем, свободна ли сегодня дорога.", "hi": "हम आज बाग में टहलेंगे।", "en": "We do not know whether the road is free today."}
    rows = [(k, t, lang.upper() + "-XX") for k, (lang, t) in enumerate(held.items())] + [(50, held["en"] + " " + held["de"], "en"), (51, "", None), (52, None, "en"), (53, held["ru"], "en"), (53, held["ru"], "en")]
    found = document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    got = {r.doc_id: [s.lang for s in r.segments] for r in found.collect()}
    assert [got[k] for k in range(len(held))] == [[x] for x in held]
    assert got[50] == ["en", "de"] and got[51] == ["und"]
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in relabelled(found).collect()) == [(50, 1, "en"), (50, 2, "de"), (53, 1, "ru")]
    assert all(0 <= s.confidence <= 1 for r in found.collect() for s in r.segments)


def test_within_sentences(spark, docs):
    model = fit_model(docs)
    mixed = ["We walked to the station and dann haben wir den Zug genommen, weil es geregnet hat, so we were late.", "Primero miro la fila porque the answer is not what we need here, y entonces no hay más."]
    rows = [(k, t, "en") for k, t in enumerate(mixed)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.segments for r in document_languages(df, model, within=True).collect()}
    assert [s.lang for s in found[0]] == ["en", "de", "en"] and [s.lang for s in found[1]] == ["es", "en", "es"] and [s.lang for s in found[9]] == ["und"]
    assert mixed[0][found[0][1].start_pos : found[0][1].end_pos].startswith("dann haben wir")
    # whole sentences stay one segment
    assert [len(r.segments) for r in document_languages(df, model).collect()] == [1, 1, 1]


def test_names_and_unknown_languages(docs):
    from spanloom.llm.langid import segments

    model = fit_model(docs)
    known = ["Die Zahl der Zeilen bleibt gleich, und wir müssen nicht noch einmal zählen.", "Ripel用2枚caovel币换38颗珠子。Pelzoni用24枚usa币换206颗珠子。"]
    got = segments(known, model)
    assert [[s["lang"] for s in g] for g in got] == [["de"], ["zh"]] and got[0][0]["confidence"] > 0.8
    for other in ("Jeg har ikke set nogen af dem, der boede i huset ved siden af skoven.", "Η απάντηση δεν είναι γνωστή.", "Sidoo kale waxaan aragnay in ay jiraan dad badan oo meesha jooga."):
        assert segments([other], model)[0][0]["confidence"] < 0.5, other


def test_fill():
    assert fill({"a": 10, "b": 100, "c": 0}, {"a": 0.5, "b": 0.25, "c": 0.25}, 60) == {"a": 10, "b": 50, "c": 0}
    leaves = {("s", "en"): (10, 1), ("s", "de"): (30, 1), ("r", "en"): (100, 2)}
    assert budgets(leaves, {("s", "en"): 0.72, ("s", "de"): 0.08, ("r", "en"): 0.2}, 50) == {("s", "en"): 10.0, ("s", "de"): 30.0, ("r", "en"): 10.0}


def test_tree_of_domains():
    # a short source leaves its part to its siblings first: notes in German stay as many as before
    leaves = {("note", "de", "a"): (10, 1), ("note", "de", "b"): (90, 2), ("note", "en", "b"): (100, 2), ("talk", "en", "c"): (100, 2)}
    weights = {("note", "de", "a"): 0.3, ("note", "de", "b"): 0.2, ("note", "en", "b"): 0.2, ("talk", "en", "c"): 0.3}
    got = budgets(leaves, weights, 100)
    assert got == {("note", "de", "a"): 10, ("note", "de", "b"): pytest.approx(40), ("note", "en", "b"): pytest.approx(20), ("talk", "en", "c"): pytest.approx(30)}
    # sources get their shares of what all give: 10, and 0.4 to 0.3 of the rest
    fitted = source_budgets(leaves, {"a": 0.3, "b": 0.4, "c": 0.3, "absent": 0.0}, 100)
    by = {s: sum(v for p, v in fitted.items() if p[-1] == s) for s in "abc"}
    assert by == {"a": pytest.approx(10, abs=1e-3), "b": pytest.approx(90 * 4 / 7, abs=1e-3), "c": pytest.approx(90 * 3 / 7, abs=1e-3)}
    # a domain's given weight stands before the shares
    forced = source_budgets(leaves, {"a": 0.3, "b": 0.4, "c": 0.3}, 100, {("note",): 0.5, ("talk",): 0.5})
    assert sum(v for p, v in forced.items() if p[0] == "talk") == pytest.approx(50, abs=1e-3)


def test_mixture(spark):
    rows = [(k, "word " * (1 + k % 5), "en", ["big", "Small-Src", None, "none"][k % 4 if k % 4 < 2 else 2 + k % 2]) for k in range(200)] + [(900, None, "en", "big"), (901, "", "en", "big"), (0, "word ", "en", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("big", 0.25, 1), ("small_src", 0.5, 3), ("absent", 0.25, 2)], "source string, target_share double, max_repeats int")
    size = {r.doc_id: r.tokens for r in count_tokens(docs, {"doc_id": "long"}).collect()}
    got = mixture(docs, targets, slots=16).collect()
    cap = {"big": 1, "small_src": 3}
    assert len({r.doc_id for r in got}) == len(got) and all(0 < r.repeats <= cap[r.source] and r.tokens == size[r.doc_id] > 0 for r in got)
    shares = {r.source: r for r in mixture_shares(docs, targets, slots=16).collect()}
    assert shares["absent"].tokens == 0 and abs(shares["small_src"].actual_share - 2 / 3) < 0.03
    again = mixture(docs, targets, slots=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixture(docs.limit(0), targets).count() == 0 and mixture(docs, targets.limit(0)).count() == 0
