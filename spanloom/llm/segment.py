"""Sentence units of a text, with their positions, in any language and layout.

Lines are read first: fenced code, display formulas, headings and list items are units of their own; the lines of a
paragraph are joined where the sentence runs on. Within a paragraph the cascaded rule tables of ``segment_rules`` decide
each position after a sentence mark; quotations and brackets are kept whole, and Thai breaks at its blanks.

Null and values without a letter or digit have no unit. Positions count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.languages import cyrillic_language, latin_language
from spanloom.llm.segment_rules import CLOSERS, TERMINATORS, cascade_for

_FENCE = regex.compile(r"\s*(```+|~~~+)")
_FORMULA = regex.compile(r"\s*(\\\[|\$\$|\\begin\{(?:equation|align|gather|multline|displaymath)\*?\})")
_FORMULA_END = {"\\[": "\\]", "$$": "$$"}
_HEADING = regex.compile(r"\s*(?:#{1,6}\s+\S.*|\*\*[^*\n]+\*\*:?|__[^_\n]+__:?)\s*\Z")
_ITEM = regex.compile(r"\s*(?:[-*•‣◦▪–—·]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|\(?[ivx]{1,4}\)|[①-⑳])\s+\S")
_NUMBERED = regex.compile(r"\s*\d{1,3}\.\s")
_RULE = regex.compile(r"\s*(?:[-*_=]{3,})\s*\Z")
_ENDED = regex.compile(rf"[{regex.escape(TERMINATORS)}][{CLOSERS}\s]*\Z")
_ABBREVIATED = regex.compile(
    r"(?<![\p{L}\p{N}])(?:Sec|Eq|Fig|No|no|Vol|pp|p|cf|Cf|vs|approx|i\.e|e\.g|Dr|Prof|Mr|Mrs|Ms|et al|z\.\s?B|d\.\s?h|Gl|Abb|Nr|éq|ec|eq|p\.\s?ex|p\.\s?ej|M|Sr|Sra|verg|bijv|т\.\s?е|ур|рис|рів|мал|див|\p{Lu})\.\Z"
)
_OPEN_END = regex.compile(
    r"(?:[,;:(\[{=+\-–—<>*/×&،、，：；]|(?<![\p{L}\p{N}'])(?i:the|a|an|of|and|or|with|for|to|is|are|was|in|on|at|by|as|that|which|than|from|be|must|can|has|have|"
    r"not|if|so|no|near|past|toward|between|into|over|under|per|unless|where|when|whose|who|says|said|calls|called|every|each|any|its|their|this|der|die|das|und|oder|mit|von|zu|im|in|ist|den|dem|des|ein|eine|als|auf|dass|frau|herr|aus|bei|nach|um|ob|wie|le|la|les|de|du|des|et|ou|que|est|un|une|dans|el|los|las|y|o|por|"
    r"con|del|al|es|em|e|do|da|no|na|um|uma|il|lo|gli|di|che|per|het|een|en|van|op|и|в|на|что|с|не|по|і|у|що|з))\Z"
)
_QUICK = regex.compile(rf"[^{regex.escape(TERMINATORS)}\n\u0e00-\u0e7f]*[.!?。！？।؟]?\s*\Z")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_MARK = re.compile(rf"[{re.escape(TERMINATORS)}]+(?:\s?[»])?[{CLOSERS}]*")
_THAI_GAP = regex.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
_OPENERS = re.compile(r"[`$\"„“«「『(（\[]|\\\(")
_CLOSERS_OF = {'"': '"', "„": "“”", "“": "”", "«": "»", "「": "」", "『": "』"}
_BRACKETS = {"(": ")", "（": "）", "[": "]"}
_UNCLOSED = regex.compile(r"[\"„“«「『]|(?<![\p{L}\p{N}])\(")
_SCRIPTS = [("latin", regex.compile(r"\p{Latin}")), ("cyrillic", regex.compile(r"\p{Cyrillic}")), ("arabic", regex.compile(r"\p{Arabic}")), ("devanagari", regex.compile(r"\p{Devanagari}"))]
_BEYOND_LATIN = regex.compile(r"[\p{Cyrillic}\p{Arabic}\p{Devanagari}]")
_LATIN_LETTER = regex.compile(r"\p{Latin}")
_WORD_BEFORE = regex.compile(r"(?r)\p{L}")
_CLOSING = set("\"'’”»“」』）)]】》*_")
_CASED = regex.compile(r"[\p{Lu}\p{Ll}]")
_TIGHT = regex.compile(r"[,.;:!?%)\]}»”’。！？，、；：」』）।؟،]")
_FIRST_LETTER = regex.compile(r"[\"'“„«(\[*_]*")


def _script(text: str) -> str:
    if text.isascii():
        return "latin"
    counts = {name: len(pattern.findall(text)) for name, pattern in _SCRIPTS}
    # letters of formulas and invented names don't make a text Latin
    counts["latin"] *= 0.5 if max(counts["cyrillic"], counts["arabic"], counts["devanagari"]) > 20 else 1
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class _Tables:
    """The cascade of each mark of a block: by the script of the block, or, in one of several scripts, of the words before the
    mark, and by the language of the sentence so far, else with what follows, else of the block, else of the text; all of the
    script's where none tells."""

    def __init__(self, text: str, start: int, end: int, default: str, of_text: Callable[[str], str | None], plain: bool = False):
        block = text[start:end]
        self.block, self.of_text = block, of_text
        self.mixed = False
        if plain or block.isascii():
            self.script = "latin" if _LATIN_LETTER.search(block) else default
        else:
            script = _script(block)
            self.script = default if script == "other" else script
            self.mixed = bool(_BEYOND_LATIN.search(block)) and sum(bool(pattern.search(block)) for _, pattern in _SCRIPTS) > 1
        self.read = self.latin = 0
        self.beyond = False
        self.last: str | None = None
        self.own: dict[str, str | None] = {}

    def script_at(self, text: str, opened: int, mark: int) -> str:
        if not self.mixed:
            return self.script
        if self.read <= opened:
            self.read, self.latin, self.beyond, self.last = opened, 0, False, None
        self.latin += len(_LATIN_LETTER.findall(text, self.read, mark))
        self.beyond = self.beyond or bool(_BEYOND_LATIN.search(text, self.read, mark))
        if found := _WORD_BEFORE.search(text, self.read, mark):
            self.last = next((name for name, pattern in _SCRIPTS if pattern.match(found[0])), None)
        self.read = max(self.read, mark)
        if self.last == "latin" and (self.beyond or self.latin < 3):  # a name or a formula within a sentence
            return self.script
        return self.last or self.script

    def breaks(self, text: str, opened: int, mark: int, stop: int) -> bool:
        script = self.script_at(text, opened, mark)
        cascade = cascade_for(script)
        if stop - mark == 1 and (quick := cascade.plain(text, opened, mark, stop)) is not None:
            return quick
        if script in _TELL and cascade.hangs_on_language(text, opened, mark):
            tell = _TELL[script]
            # what follows belongs to the sentence if it goes on
            if (language := tell(text[opened:mark]) or tell(text[opened : mark + 60])) is None:
                if script not in self.own:
                    self.own[script] = tell(self.block) or self.of_text(script)
                language = self.own[script]
            if language:
                cascade = cascade_for(script, language)
        return cascade.breaks(text, opened, stop)


_TELL: dict[str, Callable[[str], str | None]] = {"latin": lambda t: latin_language(t.lower().replace("’", "'"), 2, 1.3), "cyrillic": cyrillic_language}


def _ended(line: str) -> bool:
    tail = line.rstrip()
    if not tail or (tail[-1] not in TERMINATORS and tail[-1] not in _CLOSING):
        return False
    return bool(_ENDED.search(tail)) and not (tail[-1] == "." and _ABBREVIATED.search(tail))


def _kind(body: str) -> str:
    """What a line is by its first characters: blank, rule, fence, formula, heading, item or text."""
    core = body.lstrip()
    if not core:
        return "blank"
    c = core[0]
    if c in "-*_=" and _RULE.match(core):
        return "rule"
    if c in "`~" and _FENCE.match(core):
        return "fence"
    if c in "\\$" and _FORMULA.match(core):
        return "formula"
    if c in "#*_" and _HEADING.match(core):
        return "heading"
    if (not c.isalpha() or core[1:2] == ")" or core[2:3] == ")") and _ITEM.match(core):
        return "item"
    return "text"


def _starts_lower(line: str, at: int = 0) -> bool:
    c = line[at : at + 1]
    if c.isalpha():
        return c.islower()
    m = _FIRST_LETTER.match(line, at)
    return line[m.end() : m.end() + 1].islower()


def _wrapped(lines: list[str], kinds: list[str], ended: list[bool]) -> bool:
    """Whether line breaks of this text fall within sentences: known from how unended lines go on."""
    pairs = [k for k in range(len(lines) - 1) if kinds[k] == kinds[k + 1] == "text" and not ended[k]]
    widest = max((len(lines[k]) for k in pairs), default=0)
    total = lower = cased = full = 0
    for k in pairs:
        total += 1
        body = lines[k + 1].lstrip()
        cased += bool(_CASED.match(body))
        lower += _starts_lower(body)
        full += len(lines[k]) + 1 + min(len(body.split(" ", 1)[0]), 12) > widest or bool(_TIGHT.match(body))
    if not total:
        return False
    # a wrapped line has no room for the word that follows it
    if full < 0.9 * total:
        return False
    return lower >= 0.15 * total if cased >= 0.5 * total else total >= 2


def _runs_on(a: str, b: str, wrapped: bool, few: bool) -> bool:
    body = b.lstrip()
    if wrapped or _TIGHT.match(body):
        return True
    tail = a.rstrip()
    if _ABBREVIATED.search(tail) or _OPEN_END.search(tail):
        return True
    if body[:1] in tuple("`$+=<>×·/") or body.startswith("\\("):  # no sentence begins with a formula
        return True
    if few and not _CASED.match(_FIRST_LETTER.sub("", body, 1)) and body[:1].isalpha():
        return True
    if tail.count("(") > tail.count(")") or tail.count("$") % 2 or tail.count('"') % 2:
        return True
    return _starts_lower(body) or (few and body[:1].isdigit())


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): pieces of the text; a whole one is one unit, the others are paragraphs."""
    lines: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    bodies = [text[a:b] for a, b in lines]
    kinds = [_kind(x) for x in bodies]
    ended = [_ended(x) for x in bodies] if len(bodies) > 1 else [False]
    wrapped = _wrapped(bodies, kinds, ended)
    few = sum(1 for k in kinds if k != "blank") <= 3
    i, n = 0, len(lines)
    while i < n:
        body, kind = bodies[i], kinds[i]
        if kind in ("blank", "rule"):
            i += 1
            continue
        if kind == "fence":
            mark = _FENCE.match(body)[1]
            j = i + 1
            while j < n and not bodies[j].lstrip().startswith(mark):
                j += 1
            j = min(j, n - 1)
            yield lines[i][0], lines[j][1], True
            i = j + 1
            continue
        if kind == "formula":
            formula = _FORMULA.match(body)
            closing = _FORMULA_END.get(formula[1], formula[1].replace("begin", "end"))
            j, offset = i, formula.end()
            while j < n and closing not in bodies[j][offset if j == i else 0 :]:
                if j > i and kinds[j] == "blank":
                    break
                j += 1
            if j < n and closing in bodies[j]:
                rest = bodies[j][bodies[j].index(closing, offset if j == i else 0) + len(closing) :]
                if not _ALNUM.search(rest):
                    yield lines[i][0], lines[j][1], True
                    i = j + 1
                    continue
            elif j >= n:
                yield lines[i][0], lines[n - 1][1], True
                i = n
                continue
        if kind == "heading":
            yield lines[i][0], lines[i][1], True
            i += 1
            continue
        item = kind == "item"
        j = i
        while j + 1 < n and not ended[j] and kinds[j + 1] in ("text", "item"):
            # an item of a list goes on only where its own words show it
            if not _runs_on(bodies[j], bodies[j + 1], wrapped and not item, few):
                break
            if kinds[j + 1] == "item":
                # a number or a minus that wrapping brought to the front of a line
                tail = bodies[j].rstrip()
                numbered = _NUMBERED.match(bodies[j + 1]) and (wrapped and not item or _ABBREVIATED.search(tail))
                if not (numbered or (wrapped and not item and tail.count("$") % 2)):
                    break
            j += 1
        yield lines[i][0], lines[j][1], item
        i = j + 1


def _bracket_pairs(text: str, start: int, end: int) -> dict[int, int]:
    """The place of each bracket that is closed, with that of the bracket that closes it."""
    out: dict[int, int] = {}
    for opening, closing in _BRACKETS.items():
        if text.find(opening, start, end) < 0:
            continue
        stack: list[int] = []
        for m in re.finditer(f"[{re.escape(opening + closing)}]", text[start:end]):
            if m[0] == opening:
                stack.append(start + m.start())
            elif stack:
                out[stack.pop()] = start + m.start()
    return out


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations, brackets, formulas and code of a paragraph, of any length. Each sign is looked at a few times."""
    out: list[tuple[int, int]] = []
    brackets: dict[int, int] | None = None
    none: dict[str, int] = {}  # up to where a closing mark is known not to come
    found: dict[str, int] = {}  # where it comes next
    line_end = at = start

    def closing(mark: str, low: int, high: int) -> int:
        if found.get(mark, -1) >= low:
            return found[mark] if found[mark] < high else -1
        if low <= none.get(mark, -1):
            return -1
        j = text.find(mark, low, high)
        if j < 0:
            none[mark] = high
        else:
            found[mark] = j
        return j

    while m := _OPENERS.search(text, at, end):
        i, c = m.start(), m[0]
        at = i + 1
        if i >= line_end:
            line_end = text.find("\n", i, end)
            line_end = end if line_end < 0 else line_end
        j = -1
        if c in _CLOSERS_OF:
            ends = [k for mark in _CLOSERS_OF[c] if (k := closing(mark, i + 1, end)) >= 0]
            j = min(ends, default=-1)
        elif c in _BRACKETS:
            if brackets is None:
                brackets = _bracket_pairs(text, start, end)
            j = brackets.get(i, -1)
            if c == "[" and j > line_end:
                j = -1
        elif c == "\\(":
            j = closing("\\)", i + 2, line_end)
            if j >= 0:
                j += 1
        else:
            j = closing(c, i + 1, line_end)
            # far apart, two signs of money are no formula
            if c == "$" and j - i > 201 and (text[i + 1].isspace() or text[j - 1].isspace() or text[j + 1 : j + 2].isdigit()):
                j = -1
        if j > i + 1:
            out.append((i, j + 1))
            at = j + 1
    return out


def _guarded(text: str, start: int, end: int, last: bool) -> list[tuple[int, int]]:
    spans = _pairs(text, start, end)
    if last:  # what a cut left open stays open to the end
        tail = spans[-1][1] if spans else start
        if (m := _UNCLOSED.search(text, tail, end)) and m.start() > start:
            spans.append((m.start(), end + 1))
    return spans


def _sentences(text: str, start: int, end: int, tables: _Tables, last: bool) -> Iterator[tuple[int, int]]:
    spans = _guarded(text, start, end, last)
    cuts: list[tuple[int, int]] = []
    opened = start
    k = 0
    window = text[:end] if end < len(text) else text
    for m in _MARK.finditer(text, start, end):
        at, stop = m.start(), m.end()
        if stop >= end:  # the paragraph ends here in any case
            break
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k < len(spans) and spans[k][0] < at < spans[k][1]:
            low, high = spans[k]
            if stop < high:
                continue
            if text[low] in "([（" and text[low - 1 : low] != "\\":
                # a bracketed sentence ends its unit only if it began it
                if text[opened:low].strip():
                    continue
                cuts.append((stop, stop))
                opened = stop
                continue
            if text[low] in "`$\\":
                continue
        if tables.breaks(window, opened, at, stop):
            cuts.append((stop, stop))
            opened = stop
    if _THAI_GAP.search(text, start, end):
        guarded = [s for s in spans if text[s[0]] in "\"“„«(（["]
        for m in _THAI_GAP.finditer(text, start, end):
            if not any(a < m.start() < b for a, b in guarded):
                cuts.append((m.start(), m.end()))
        cuts.sort()
    at = start
    for a, b in cuts:
        yield at, a
        at = b
    yield at, end


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit."""
    if not text or not _ALNUM.search(text):
        return []
    if _QUICK.match(text):
        a = len(text) - len(text.lstrip())
        return [(a, len(text.rstrip()))]
    plain = text.isascii() or not _BEYOND_LATIN.search(text)
    script = ("latin" if _LATIN_LETTER.search(text) else "other") if plain and not text.isascii() else _script(text)
    known: dict[str, str | None] = {}

    def of_text(script: str) -> str | None:
        if script not in known:
            known[script] = _TELL[script](text)
        return known[script]

    pieces = list(_blocks(text))
    out: list[tuple[int, int]] = []
    for k, (start, end, whole) in enumerate(pieces):
        parts = [(start, end)] if whole else _sentences(text, start, end, _Tables(text, start, end, script, of_text, plain), k == len(pieces) - 1)
        for a, b in parts:
            piece = text[a:b]
            left = len(piece) - len(piece.lstrip())
            core = piece.strip()
            if not core:
                continue
            if not _ALNUM.search(core):
                # marks without a word belong to the unit before them on the same line
                if out and not whole and "\n" not in text[out[-1][1] : a + left]:
                    out[-1] = (out[-1][0], a + left + len(core))
                continue
            out.append((a + left, a + left + len(core)))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``flat``: the positions of the units of the last column, start and end in turn; drops the text."""
    seen: dict[str, list[int]] = {}
    for b in batches:
        flat = []
        for text in b.column(b.num_columns - 1).to_pylist():
            if text is not None and len(text) < 200:
                if (got := seen.get(text)) is None:
                    if len(seen) > 20_000:
                        seen.clear()
                    got = seen[text] = [x for u in units(text) for x in u]
            else:
                got = [x for u in units(text) for x in u]
            flat.append(got)
        names = b.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(flat, pa.list_(pa.int32()))], [*names, "flat"])


def with_units(df: DataFrame, keys: dict[str, str], text: str) -> DataFrame:
    """The key columns (name -> type) and ``flat``, the units' positions of ``text``: map-side, no shuffle."""
    schema = ", ".join([*[f"`{k}` {t}" for k, t in keys.items()], "flat array<int>"])
    return df.select(*keys, text).mapInArrow(_run, schema)


def _explode(df: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.size("flat") - 2, F.lit(2)))
    return (
        df.where(F.size("flat") > 0)
        .select("*", at.alias("_i"))
        .withColumn("start_pos", F.get("flat", F.col("_i")))
        .withColumn("end_pos", F.get("flat", F.col("_i") + 1))
        .drop("flat", "_i")
    )


def corpus_units(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace_id, field, span_idx, start_pos, end_pos) of the units of every reasoning and every anchor.

    Texts are segmented where they are read; only positions are shuffled, to keep one delivery of each key.
    """
    reason = with_units(traces, {"trace_id": "string"}, "reasoning").groupBy("trace_id").agg(F.max("flat").alias("flat"))
    anchor = (
        with_units(spans.where(F.col("anchor").isNotNull()), {"trace_id": "string", "span_idx": "int"}, "anchor")
        .groupBy("trace_id", "span_idx")
        .agg(F.max("flat").alias("flat"))
    )
    both = reason.select("trace_id", F.lit("reasoning").alias("field"), F.lit(-1).alias("span_idx"), "flat").unionByName(
        anchor.select("trace_id", F.lit("anchor").alias("field"), "span_idx", "flat")
    )
    return _explode(both).select("trace_id", "field", "span_idx", "start_pos", "end_pos")
