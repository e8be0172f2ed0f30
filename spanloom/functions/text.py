"""Text functions from column to column: masks, sentence lists, openers, counts, cuts.

Null gives null unless a docstring says otherwise; lengths and positions count code points; white space is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and sizes that segmentation is defined by.
CODE = r"```[\s\S]*?```|`[^`\n]+`"
MATH = r"\$[^\$\n]{1,80}\$|\\\([^\)]{1,80}\\\)"
INLINE_BREAK = r"(?<=[.!?])(?U:\s)+(?=[A-Z\[\"])"
BULLET = r"^(?U:\s)*(?:\d+[\.\)](?U:\s)+|[-•*](?U:\s)+)"
LONG_LINE, SHORTEST = 120, 4


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+\z", "")


def fallback_text(*cs: Column) -> Column:
    """The first that is neither null nor empty; else an empty string."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cs], F.lit(""))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def mask(c: Column) -> Column:
    """Code, then formulas, replaced by their placeholders."""
    return F.regexp_replace(F.regexp_replace(unix_lines(c), CODE, " [CODE] "), MATH, " [MATH] ")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda p: F.length(p) > 0)


def inline_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, INLINE_BREAK), strip), lambda s: F.length(s) > 0)


def sentence_list(c: Column) -> Column:
    """Sentences of a text: paragraphs, then their lines where there are several, then breaks before capitals.

    Lines under 120 signs stay whole; what is shorter than four signs or only a placeholder is dropped. Null gives an
    empty array.
    """
    by_line = lambda p: F.flatten(
        F.transform(F.split(p, "\n"), lambda x: F.when(F.length(strip(x)) >= LONG_LINE, inline_sentences(strip(x))).otherwise(F.array(strip(x))))
    )
    found = F.flatten(F.transform(paragraphs(mask(c)), lambda p: F.when(F.contains(p, F.lit("\n")), by_line(p)).otherwise(inline_sentences(p))))
    kept = F.filter(found, lambda s: (F.length(s) >= SHORTEST) & ~s.isin("[CODE]", "[MATH]"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def alpha_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))


def opener(c: Column, n: int = 3) -> Column:
    """The first ``n`` tokens of a sentence that begins with a capital, joined by blanks; else an empty string."""
    return F.when(c.rlike(r"^(?U:\s)*\p{Lu}"), F.array_join(F.slice(alpha_tokens(c), 1, n), " ")).otherwise("")


def structural(sentence: Column, before: Column, index: Column) -> Column:
    """Whether a sentence opens a span by its form: the first, a list item, or a question after none."""
    asks = sentence.endswith("?") & before.isNotNull() & ~before.endswith("?")
    return (index == 0) | sentence.rlike(BULLET) | F.coalesce(asks, F.lit(False))


def words(c: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(strip(c), r"(?U:\s)+"), lambda w: F.length(w) > 0)


def word_density(c: Column, pattern: str) -> Column:
    """Matches of a pattern, case ignored, for each word of the text."""
    return F.regexp_count(c, F.lit(f"(?i){pattern}")) / F.greatest(F.size(words(c)), F.lit(1))


def containing_share(c: Column, part: str) -> Column:
    """Share of the words that contain a part, case ignored; 0 without words."""
    ws = words(F.lower(c))
    return F.size(F.filter(ws, lambda w: F.contains(w, F.lit(part)))) / F.greatest(F.size(ws), F.lit(1))


def log_length(c: Column) -> Column:
    return F.log1p(F.length(c))


def percent_prefix(c: Column, percent: int, cap: int | None = None) -> Column:
    """The first ``percent`` of the signs, one at least, and of them at most ``cap``."""
    n = F.greatest(F.lit(1), F.floor(F.length(c) * percent / 100)).cast("int")
    head = F.left(c, n)
    return head if cap is None else F.left(head, F.lit(cap))


def topic_sentence(anchor: Column, body: Column, cap: int, whole: bool = False) -> Column:
    """Anchor and body up to the first sentence mark before white space, at most ``cap`` signs; ``whole`` leaves the cut out."""
    text = full_text(anchor, body)
    cut = text if whole else F.coalesce(F.nullif(F.regexp_extract(text, r"^([\s\S]*?[.!?])(?U:\s)", 1), F.lit("")), text)
    return F.left(cut, F.lit(cap))


def span_text(anchor: Column, body: Column, least: int = 30) -> Column:
    """Anchor and first line of the body, cut after the first sentence mark before white space beyond ``least`` signs."""
    text = strip(F.concat_ws(" ", anchor, F.get(body, F.lit(0))))
    at = F.regexp_instr(text, F.lit(r"[.!?](?U:\s)"))
    return F.when(at - 1 > least, F.left(text, at)).otherwise(text)


def full_text(anchor: Column, body: Column) -> Column:
    return strip(F.concat_ws(" ", anchor, F.array_join(body, " ")))


def first_word(c: Column) -> Column:
    """The first word in lower case without marks at its end; null without one."""
    return F.regexp_replace(F.lower(F.get(words(c), F.lit(0))), r"[.,!?;:'\"]+\z", "")


def cell(c: Column) -> Column:
    """A share as two decimals without the leading zero; blank under half a percent."""
    return F.when(c < 0.005, F.lit("")).otherwise(F.regexp_replace(F.format_string("%.2f", c), r"^0", ""))


def safe_name(c: Column) -> Column:
    """A name for a file: no slashes, no .json at its end."""
    return F.regexp_replace(F.replace(c, F.lit("/"), F.lit("_")), r"\.json\z", "")


def locate_forward(text: Column, parts: Column, short: int = 60) -> Column:
    """Start of each part in the text at or after the end of the one found before; else of its first ``short`` signs; else null.

    Parts are looked for without white space at their ends; blank ones and null have no place. The cursor moves on by the
    length of the whole part, also where only its first signs were found.
    """
    seed = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, part: Column) -> Column:
        whole = F.position(part, text, acc["cursor"] + 1)
        head = F.position(F.left(part, F.lit(short)), text, acc["cursor"] + 1)
        hit = F.when(F.length(part) > 0, F.when(whole > 0, whole).when(head > 0, head))
        moved = F.when(hit.isNotNull(), hit - 1 + F.length(part)).otherwise(acc["cursor"])
        return F.struct(moved.cast("int").alias("cursor"), F.array_append(acc["at"], (hit - 1).cast("int")).alias("at"))

    return F.aggregate(F.transform(parts, strip), seed, step, lambda acc: acc["at"])


def mark_region(text: Column, start: Column, end: Column, opening: str = "<<", closing: str = ">>") -> Column:
    """The text with marks around the signs from ``start`` to before ``end``, both from 0; unmarked where the start is null."""
    marked = F.concat(F.left(text, start), F.lit(opening), F.substring(text, start + 1, end - start), F.lit(closing), F.substring(text, end + 1, F.length(text)))
    return F.when(start.isNull(), text).otherwise(marked)
