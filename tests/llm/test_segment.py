import pytest

from spanloom.llm.segment import corpus_units, units


def cut(text):
    return [text[a:b] for a, b in units(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []),
        ("", []),
        ("```\n```", []),
        ("See Eq. 4 and Fig. 2, i.e. 3.5 of it. Dr. A. B. Cee left!", ["See Eq. 4 and Fig. 2, i.e. 3.5 of it.", "Dr. A. B. Cee left!"]),
        ("So ... yes: m = 24! Hmm... that looks odd.", ["So ... yes: m = 24!", "Hmm... that looks odd."]),
        ('The note says "One. Two." and goes on. "No," says X, "is it." End', ['The note says "One. Two." and goes on.', '"No," says X, "is it."', "End"]),
        ("Das heißt, z. B. so. Am 8. Schritt ist Schluss, d. h. jetzt.", ["Das heißt, z. B. so.", "Am 8. Schritt ist Schluss, d. h. jetzt."]),
        ("имеет 4 членов, т. е. больше нельзя. По ур. 5 так.", ["имеет 4 членов, т. е. больше нельзя.", "По ур. 5 так."]),
        ("题目说：“每个格子。不变。”所以是3。真的吗？", ["题目说：“每个格子。不变。”", "所以是3。", "真的吗？"]),
        ("問題文には「一度。」とあります。次へ。", ["問題文には「一度。」とあります。", "次へ。"]),
        ("เท่ากับ 9 จริง ก่อนอื่นเรา", ["เท่ากับ 9 จริง", "ก่อนอื่นเรา"]),
        ("# Head\nOne two\nthree four.\n1. Item a. Still a.\n2. Item b\n\\[ x = 1 \\]\nEnd of it.", ["# Head", "One two\nthree four.", "1. Item a. Still a.", "2. Item b", "\\[ x = 1 \\]", "End of it."]),
        ("Use this:\n```py\nx = 1.\ny = 2\n```\nDone it is.", ["Use this:", "```py\nx = 1.\ny = 2\n```", "Done it is."]),
        ("and that's it.The rule gives f.name(x) of notes.b.", ["and that's it.", "The rule gives f.name(x) of notes.b."]),
        ("(It was so from the start.) Next (see Sec. 4. of it) now.", ["(It was so from the start.)", "Next (see Sec. 4. of it) now."]),
        ("It was. The res […]", ["It was.", "The res […]"]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


def test_long_and_odd_texts():
    assert len(units("A b c. " * 20_000)) == 20_000
    assert units("." * 50_000) == []
    assert units('"' * 3001 + "a") == [(0, 3002)]
    assert len(units("(" * 2000 + "a. B c.")) >= 1


def test_corpus(spark):
    t = spark.createDataFrame([("a", "One it is. Two.", 1), ("a", "One it is. Two.", 2), ("b", None, 1), (None, "X y.", 1)], "trace_id string, reasoning string, start_pos int")
    s = spark.createDataFrame([("a", 0, "Q?"), ("a", 0, "Q?"), ("a", 1, None), ("a", 2, "")], "trace_id string, span_idx int, anchor string")
    got = sorted((r.trace_id or "", r.field, r.span_idx, r.start_pos, r.end_pos) for r in corpus_units(t, s).collect())
    assert got == [("", "reasoning", -1, 0, 4), ("a", "anchor", 0, 0, 2), ("a", "reasoning", -1, 0, 10), ("a", "reasoning", -1, 11, 15)]
    assert corpus_units(t.limit(0), s.limit(0)).count() == 0


def test_tables_by_paragraph():
    english, russian = "We look at the rows and count them again. " * 40, "Это видно на рис. Петрова и в табл. Иванова. "
    german = "Das gilt z. B. Montags. "
    for gap in ("\n\n", ""):
        assert cut(english + gap + russian)[-1] == russian.strip() and cut(english + gap + russian * 80)[-1] == russian.strip()
        assert cut(russian * 40 + gap + german)[-1] == german.strip()
    assert cut(english + "\n\nयह डॉ. शर्मा का काम है।")[-1] == "यह डॉ. शर्मा का काम है।"


def test_long_quotations():
    said = "We count the rows again. " * 40
    for a, b in ('""', "“”", "«»", "()", "[]"):
        first = f"The note says {a}{said.strip()}{b} and goes on."
        assert cut(f'{first} Then we stop. It was so. The end says {a}So. It was.{b} and ends.') == [first, "Then we stop.", "It was so.", f"The end says {a}So. It was.{b} and ends."]
    for odd in ("«a. " * 30_000, "\\(a. " * 30_000, '("a. ' * 30_000, "[a\n" * 30_000):
        assert units(odd)


def test_tables_by_language():
    for text in ("It is so ca. Two more came.", "He gave it to Me. Then he left.", "They bought es. Other things followed.", "So that is what they call the number n. (It was so from the start.)"):
        first = text.split(". ")[0] + "."
        assert cut(text) == [first, text[len(first) + 1 :]]
    for text in ("D'après l'éq. 5, la limite reste sous 5,4.", "El Sr. Tolva llama a esto griel.", "Das sind ca. 5 Zeilen, vgl. Abb. 3 und Gl. 4.", "We call it ori, a.k.a. the linear one."):
        assert cut(text) == [text] and cut("The rows that we count are these. " * 5 + text)[-1] == text
    # a rule looks back as far as it needs
    assert len(cut("Am" + " " * 60 + "8. Schritt ist Schluss mit der Zählung.")) == 1
