"""Broken question and answer pairs, by ordered rules.

Every rule that holds gives a defect: ``empty``, ``truncated`` (the operator of that name), ``refusal``, ``copy``,
``other_language``. An empty answer has no further defect of its own; the other rules are tried each by itself. A
null or blank question leaves ``copy`` and ``other_language`` out. Copies of a trace count once: texts are judged where
they are read, and only the defects are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.languages import cyrillic_language, latin_language
from spanloom.llm.pairs_text import ANSWERED, EMPTY_WORDS, LABELS, REFUSALS
from spanloom.llm.segment import units
from spanloom.llm.truncation import FIELDS, deliveries, delivery_hash, truncated

_WRAPPER = regex.compile(r"</?[\p{L}_|:-]{1,30}/?>|<\|[^|>]{0,30}\|>|\\(?:boxed|text|mathrm)\b|^\s*```\w*\s*$", regex.M)
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_LABELS, _EMPTY, _ANSWERED = (regex.compile(p, regex.I | regex.M) for p in (LABELS, EMPTY_WORDS, ANSWERED))
_WRAPPER_OR_WORD = regex.compile(rf"(?:{_WRAPPER.pattern})|(?P<word>[\p{{L}}\p{{M}}\p{{N}}]+)", regex.M)
_EMPTY_VOCABULARY = frozenset(regex.findall(r"[\p{L}\p{M}\p{N}]+", (LABELS + " " + EMPTY_WORDS).replace("\\A", " ").lower()))
_REFUSALS = {k: (tuple(parts.split("|")) if parts else (), regex.compile(phrases)) for k, (parts, phrases) in REFUSALS.items()}
_QUESTION_LABEL = regex.compile(r"\A[>*_#\s]*(?:the\s+)?(?:problem|question|task|prompt|exercise|q)\s*(?:statement)?[*_]*\s*[:：]|^\s*[*_]*[\p{L}\p{M} ]{2,24}[:：][*_]*\s*\Z", regex.I | regex.M)
_WORD = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Arabic}\p{Devanagari}\p{Hangul}\p{M}\p{N}]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_SIGNS = re.compile("[฀-๿぀-ヿ㐀-鿿]+")
_FRESH = regex.compile(r"(?:\p{N}+|[a-e])\Z")
_NOT_PROSE = re.compile(r"```[^`]*(?:```|\Z)|`[^`\n]*`|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\boxed\{[^}]*\}|https?://\S+")
_BARE_ANSWER = regex.compile(r"^\s*[*_]*[\p{L}\p{M} ]{2,20}[*_]*\s?[:：]\s*[*_]*[\p{L}\p{N}.,-]{1,12}[*_]*\s*$|(?:\n|(?<=[.!?]\s))\s*[*_]*[\p{L}\p{M}]{4,12}\s?[:：]\s*[*_]*[\p{N}A-E]+[*_]*\s*\Z", regex.M)
_WORK = regex.compile(r"[=≈≡≤≥<>]\s*[\p{N}\p{L}(\\$-]|\p{N}\s*[+*/×·÷^]|\$[^$\n]+\$|\\[(\[]|```")
#: Blocks of letters by script.
_RUNS = re.compile(
    "(?P<cyrillic>[Ѐ-ԯ]+)|(?P<ar>[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufefc]+)|(?P<hi>[\u0900-\u097f]+)|(?P<ko>[\u1100-\u11ff\u3130-\u318f\uac00-\ud7af]+)"
    "|(?P<th>[\u0e01-\u0e4e]+)|(?P<kana>[\u3041-\u309f\u30a1-\u30ff]+)|(?P<han>[\u3400-\u4dbf\u4e00-\u9fff]+)"
)
_LETTERS_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")

def is_empty(text: str | None) -> bool:
    """Null, or nothing left but white space, invisible characters, wrappers, labels or placeholders."""
    if text is None:
        return True
    # the first word that is in no wrapper, label or placeholder decides, without reading on
    for m in _WRAPPER_OR_WORD.finditer(text):
        if (word := m["word"]) and word.lower() not in _EMPTY_VOCABULARY and word.strip("xX"):
            return False
    bare = _OTHER.sub(" ", _WRAPPER.sub(" ", text)).strip().lower()
    bare = _LABELS.sub(" ", f" {bare} ").strip()
    return not bare or bool(_EMPTY.match(bare))


def is_refusal(text: str, question: str | None = None, *, share: float = 0.125) -> bool:
    """It declines, in one of the languages known, and states no answer; however long it is.

    Sentences that restate the question neither answer nor work. A text that goes on to work after it declined ('I can't
    solve this directly, so let n = 4') declines only where ``share`` of its other sentences do.
    """
    low = text.lower().replace("’", "'")
    latin = low.isascii()
    # a group's phrases are tried where one of their parts is there, or letters beyond ASCII
    hit = [phrases for parts, phrases in _REFUSALS.values() if (any(p in low for p in parts) if parts else not latin) and phrases.search(low)]
    if not hit:
        return False
    answered = [m.start() for m in _ANSWERED.finditer(text)]
    if answered and not question:
        return False
    asked = _question_pieces(question) if question else set()
    sentences = units(text) or [(0, len(text))]
    own = [(a, b) for a, b in sentences if not _restates(text[a:b], asked)]
    if any(a <= at < b for at in answered for a, b in own):
        return False
    declines = [any(p.search(text[a:b].lower().replace("’", "'")) for p in hit) for a, b in own]
    if not any(declines):  # a phrase over a sentence's end
        return not answered and len(own) == len(sentences)
    after = len(own) - declines[::-1].index(True)
    return sum(declines) >= share * len(own) or not any(_WORK.search(text, a, b) for a, b in own[after:])


def _restates(sentence: str, asked: set[str]) -> bool:
    got = _pieces(sentence)
    return bool(asked) and len(got & asked) >= 0.8 * len(got)


def _pieces(text: str) -> set[str]:
    """Words and numbers, and three signs together where words aren't parted by blanks."""
    low = text.lower()
    if low.isascii():
        return set(_ASCII_WORD.findall(low))
    out = set(_WORD.findall(low))
    for run in _SIGNS.findall("".join(low.split())):
        out.update(run[i : i + 3] for i in range(max(1, len(run) - 2)))
    return out


_ASKED: dict[str, set[str]] = {}


def _question_pieces(text: str) -> set[str]:
    """The pieces of a question, kept while a task meets it again and again."""
    if text not in _ASKED:
        if len(_ASKED) > 20_000:
            _ASKED.clear()
        _ASKED[text] = _pieces(text)
    return _ASKED[text]


def is_copy(answer: str, question: str, *, share: float = 0.80, covered: float = 0.55) -> bool:
    """The answer's tokens are the question's but for few, cover most of it, and no new number or single letter answers."""
    q = _question_pieces(question)
    if len(answer) > 2 * len(question) + 400 and answer.isascii():
        # a copy has at most a quarter as many other words as the question has words; a label at its edges at most 16 more
        first = _ASCII_WORD.findall(answer[: 2 * len(question) + 200].lower())[:-1]
        if len(set(first) - q) > len(q) * (1 - share) / share + 16:
            return False
    if ":" in answer or "：" in answer:
        answer = _QUESTION_LABEL.sub(" ", answer)
    a = _pieces(answer)
    both = len(a & q)
    return bool(a) and bool(q) and both >= len(a) * share and both >= len(q) * covered and not any(_FRESH.match(t) for t in a - q)


def language(text: str, ratio: float = 1.7) -> str | None:
    """The language that the text as a whole is written in, or None: too few letters or words to tell, or no one language.

    Letters of formulas and invented names don't weigh against the other scripts.
    """
    prose = _NOT_PROSE.sub(" ", text) if any(c in text for c in "`$\\/") else text
    if ":" in prose or "：" in prose:
        prose = _BARE_ANSWER.sub(" ", prose)
    if not prose.isascii():
        n = dict.fromkeys(("cyrillic", "ar", "hi", "ko", "th", "kana", "han"), 0)
        for m in _RUNS.finditer(prose):
            n[m.lastgroup] += m.end() - m.start()
        n["latin"] = sum(map(len, _LETTERS_LATIN.findall(prose)))
        wide = {k: n[k] for k in ("cyrillic", "ar", "hi", "ko", "th")} | {"cjk": n["kana"] + n["han"]}
        # a sign of these scripts says as much as some letters
        n["latin"] /= {"cjk": 3, "ko": 2}.get(max(wide, key=wide.get), 1)
        top = max(wide, key=wide.get)
        if wide[top] >= 6 and wide[top] * 2 >= n["latin"]:
            if top == "cjk":
                return "ja" if n["kana"] * 8 >= wide["cjk"] else "zh"
            if top == "cyrillic":
                return cyrillic_language(prose) or "ru"
            return top
        if n["latin"] < 12 or wide[top] * 4 >= n["latin"]:
            return None
    return latin_language(prose.lower().replace("’", "'"), ratio)


def every_defect(question: str | None, answer: str | None, asked: str | None | bool = False) -> list[str]:
    """All defects of one answer but for truncation. ``asked``: the question's language, where it is known already."""
    if is_empty(answer):
        return ["empty"]
    out = ["refusal"] if is_refusal(answer, question) else []
    if question is None or is_empty(question):
        return out
    if is_copy(answer, question):
        out.append("copy")
    own = language(question, 1.2) if asked is False else asked
    got = language(answer) if own else None
    return [*out, "other_language"] if own and got and own != got else out


def defects(question: str | None, answer: str | None, asked: str | None | bool = False) -> list[str]:
    """The first of an answer's defects, by the order of the rules; the query gives them all."""
    return every_defect(question, answer, asked)[:1]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str | None] = {}
    for b in batches:
        ids, hashes, questions, *answers = (b.column(i).to_pylist() for i in range(3 + len(FIELDS)))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for k, (i, q) in enumerate(zip(ids, questions)):
            if q is not None and q not in known:
                if len(known) > 50_000:
                    known.clear()
                known[q] = language(q, 1.2)
            for field, texts in zip(FIELDS, answers):
                for defect in every_defect(q, texts[k], known.get(q) if q is not None else None):
                    for column, value in zip(out, (i, hashes[k], field, defect)):
                        column.append(value)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], ["trace_id", "h", "field", "defect"])


def pair_defects(traces: DataFrame) -> DataFrame:
    """(trace_id, field, defect): every defect of either answer of each trace, all from the delivery that counts."""
    chosen = deliveries(traces, "problem")
    marked = traces.select("trace_id", delivery_hash("model", *FIELDS, "problem").alias("h"), "problem", *FIELDS)
    found = marked.mapInArrow(_run, "trace_id string, h long, field string, defect string").distinct()
    one = chosen.where("at = 0").select(F.col("trace_id").alias("_id"), F.col("h").alias("_h"))
    kept = found.join(one, F.col("trace_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").select("trace_id", "field", "defect")
    return kept.unionByName(truncated(traces, "problem", chosen=chosen).select("trace_id", "field", F.lit("truncated").alias("defect")))
