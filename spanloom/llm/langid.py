"""The language of every document and of each stretch of sentences in one language, with a confidence.

A bounded sample of labelled documents fits the conditional random field; its posteriors label the words of every
document, the words of a sentence decide its language together, and neighbouring sentences of one language are a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.crf import LANGUAGES, Model, fit, script, sentence_words, words
from spanloom.llm.languages import NAMES
from spanloom.llm.segment import units

SEGMENTS = "array<struct<seg_no:int, lang:string, confidence:double, start_pos:int, end_pos:int>>"


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, in whatever spelling: case, blanks, region, three letters, a name; else null."""
    known = {code: code for code in LANGUAGES} | {name: code for code in LANGUAGES for name in NAMES[code].split()}
    first = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)[\s​]+", " ")), r"[\p{L}\p{M}]+", 0)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return names[first]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence."""
    return [(a, b, sentence_words(text, a, b)) for a, b in units(text)]


def training_sample(docs: DataFrame, per_language: int, longest: int) -> DataFrame:
    """At most ``per_language`` labelled documents of each language, of at most ``longest`` signs, by the hash of their id.

    The limit by rank is applied in each task before the shuffle, so a frequent language costs no more than a rare one.
    """
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    return (
        docs.select("doc_id", "text", label_language(F.col("lang")).alias("y"))
        .where(F.col("y").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= per_language)
        .select("text", "y")
    )


def fit_model(docs: DataFrame, *, per_language: int = 200, longest: int = 20_000) -> Model:
    rows = training_sample(docs, per_language, longest).collect()  # at most per_language for each of 15 languages
    rows = sorted(rows, key=lambda r: (r.y, r.text))
    return fit([[ws for _, _, ws in sentences(r.text)] for r in rows], [LANGUAGES.index(r.y) for r in rows])


def _joined(pieces: list[tuple[int, int, int, float, int]], text: str | None) -> list[dict]:
    """Segments of neighbouring pieces (start, end, language, confidence, words) of one language, with their mean confidence."""
    found: list[list] = []
    for a, b, y, p, n in pieces:
        if found and found[-1][2] == y:
            found[-1][1] = b
            found[-1][3] += p * n
            found[-1][4] += n
        else:
            found.append([a, b, y, p * n, n])
    if not found:
        return [{"seg_no": 1, "lang": "und", "confidence": 0.0, "start_pos": 0, "end_pos": len(text or "")}]
    return [{"seg_no": k, "lang": LANGUAGES[y], "confidence": min(max(p / n, 0.0), 1.0), "start_pos": a, "end_pos": b} for k, (a, b, y, p, n) in enumerate(found, 1)]


def segments(texts: list[str | None], model: Model) -> list[list[dict]]:
    """Of each text its segments of whole sentences; one of language ``und`` and confidence 0 where no word tells any.

    The confidence is the field's probability, less where few of the words are ones that the language is known by, as in a
    text of a language that the field doesn't know.
    """
    split = [sentences(t or "") for t in texts]
    out = []
    for text, parts, (post, share) in zip(texts, split, model.sentences([[ws for _, _, ws in parts] for parts in split])):
        pieces: list[tuple[int, int, int, float, int]] = []
        best, k = post.argmax(1).tolist(), 0
        sure = (post * share)[np.arange(len(post)), best].tolist()
        for a, b, ws in parts:
            if ws:
                y = best[k]
                pieces.append((a, b, y, sure[k], len(ws)))
                k += 1
            elif pieces:
                pieces.append((a, b, pieces[-1][2], 0.0, 0))
        out.append(_joined(pieces, text) if any(script(w) for _, _, ws in parts for w in ws) else _joined([], text))
    return out


def switches(texts: list[str | None], model: Model, *, least: int = 3) -> list[list[dict]]:
    """Of each text its stretches of words of one language, within sentences too; ``least``: words that such a stretch must
    have, shorter ones belong to the stretch before them."""
    split = [[(a, b, words(t, a, b)) for a, b in units(t)] if t else [] for t in texts]
    out = []
    for text, parts, post in zip(texts, split, model.words([[[w for _, w in ws] for _, _, ws in parts] for parts in split])):
        flat = [(at, at + len(w)) for _, _, ws in parts for at, w in ws]
        best = post.argmax(1)
        edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else [0]
        pieces: list[tuple[int, int, int, float, int]] = []
        for i, j in zip(edges[:-1], edges[1:]):
            y = int(best[i]) if j - i >= least or not pieces else pieces[-1][2]
            pieces.append((flat[i][0], flat[j - 1][1], y, float(post[i:j, y].mean()), j - i))
        out.append(_joined(pieces, text))
    return out


def document_languages(docs: DataFrame, model: Model, *, within: bool = False) -> DataFrame:
    """(doc_id, label, segments): each document once, with the language its label names and its segments: of whole sentences,
    or ``within`` sentences too.

    Texts are labelled where they are read; the shuffle that keeps each doc_id once moves the segments only.
    """
    # weights, transitions and known words: 2 MB and a few hundred KB, however many documents; arrays only, which any worker can read
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())
    label_all = switches if within else segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        kind = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = label_all(part.column(2).to_pylist(), own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], ["doc_id", "label", "segments"])

    got = docs.select("doc_id", label_language(F.col("lang")).alias("label"), "text").mapInArrow(run, f"doc_id long, label string, segments {SEGMENTS}")
    return got.groupBy("doc_id").agg(F.max(F.struct("label", "segments")).alias("v")).select("doc_id", "v.label", "v.segments")


def relabelled(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang, confidence) of documents without a right label or with several segments."""
    wrong = F.col("label").isNull() | (F.size("segments") > 1) | (F.col("label") != F.element_at("segments", 1)["lang"])
    return found.where(wrong).select("doc_id", F.explode("segments").alias("s")).where(F.col("s.lang") != "und").select("doc_id", "s.seg_no", "s.lang", "s.confidence")
