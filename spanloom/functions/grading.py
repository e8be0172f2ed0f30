"""Answers taken out of responses, compared with the expected ones, and replies of judges read. Column to column.

A result is true, false, or null where the response can't be read. Null responses and answers give null. White space and
digits are Unicode's; "first" and "last" are places in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import strip

# Digits of other scripts, the letters of choices, commands that a formula's form drops with what follows.
DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩०१२३४५६७८९๐๑๒๓๔๕๖๗๘๙"
LETTERS = "ABCDEFGHIJ"
STYLES = r"\\(?:text|mathrm|mathbf|textbf|left|right|big|Big)"
YES_NO_ANSWERS = ["yes", "no", "true", "false", "valid", "invalid"]
#: How answers to the public benchmarks of these names are verified.
KINDS = {
    "math": "math", "gpqa": "choice", "aime": "integer", "livecodebench": "code", "hle": "mixed", "mmlu_pro": "choice", "arc_challenge": "choice", "bbh": "phrase", "humaneval": "code",
    "arc_agi2": "grid",
}


def plain_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, "0123456789" * 4)


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def _last(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def boxed(c: Column) -> Column:
    """What the last ``\\boxed{`` holds, to the brace that closes it; null without one or where it isn't closed."""
    tail = F.when(F.contains(c, F.lit("\\boxed{")), F.substring_index(c, "\\boxed{", -1))
    seed = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n")))

    end = F.aggregate(F.split(tail, ""), seed, step)
    return F.when(end["depth"] == 0, strip(F.left(tail, end["n"] - 1)))


def answer_field(c: Column) -> Column:
    """The rest of the line after the first ``Answer:``."""
    return strip(_first(c, r"(?i)answer(?U:\s)*:(?U:\s)*([^\n]+)"))


def choice(c: Column) -> Column:
    """The letter of a multiple-choice answer, A to J: the first that is stated, by three ways of stating in turn, else the last
    in brackets, the first in bold, the last that stands alone; null without one."""
    ws = r"(?U:\s)*"
    rules = [
        _first(c, rf"(?i)(?:the answer is|the answer:){ws}\(?([{LETTERS}])\)?"),
        _first(c, rf"(?i)answer{ws}:{ws}\$?\(?([{LETTERS}])\)?\$?"),
        _first(c, rf"(?i)(?:choose|pick|select|choice){ws}:?{ws}\(?([{LETTERS}])\)?"),
        _last(c, rf"\(([{LETTERS}])\)"),
        _first(c, rf"\*\*\(?([{LETTERS}])\)?\*\*"),
        _last(c, rf"(?<![\p{{L}}\p{{N}}_])([{LETTERS}])(?![\p{{L}}\p{{N}}_])"),
    ]
    return F.upper(F.coalesce(*rules))


def code_block(c: Column) -> Column:
    """The first fenced block, one marked as Python before one that isn't; else all from the first line that begins as code
    does; null without any."""
    fenced = F.coalesce(_first(c, r"(?s)```python(?U:\s)*?\n(.*?)```"), _first(c, r"(?s)```(?U:\s)*?\n(.*?)```"))
    bare = _first(c, r"(?ms)^((?:def |class |import |from |if |for |while |    ).*)\z")
    return strip(F.coalesce(fenced, bare))


def plain_math(c: Column) -> Column:
    """A formula in a form that can be compared: no blanks, dollars, commas, percents, commands or braces; lower case."""
    s = F.regexp_replace(strip(c), r"\.+\z", "")
    s = F.regexp_replace(s, r"(?U:\s)|[$,%]", "")
    for name in ("frac", "[dt]frac"):  # plain fractions first: they may stand inside the others
        s = F.regexp_replace(s, rf"\\{name}\{{([^}}]+)\}}\{{([^}}]+)\}}", "$1/$2")
    s = F.regexp_replace(s, r"\\sqrt\{([^}]+)\}", "sqrt($1)")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, STYLES, ""), r"\\[a-zA-Z]+", ""), r"[{}]", ""))


def as_number(c: Column) -> Column:
    text = plain_digits(c)
    return F.when(text.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text.try_cast("double"))


def number_equal(a: Column, b: Column) -> Column:
    """Whether two texts are the same number to a millionth; null unless both are numbers."""
    return F.abs(as_number(a) - as_number(b)) < 1e-6


def math_equal(answer: Column, expected: Column) -> Column:
    """By normal form, else by number where both are numbers; null without an answer."""
    x, y = plain_math(answer), plain_math(expected)
    return (x == y) | F.coalesce(number_equal(x, y), F.lit(False))


def stated_answer(c: Column) -> Column:
    """Boxed, else after ``Answer:``, else the last number."""
    return F.coalesce(boxed(c), answer_field(c), _last(c, r"-?\p{Nd}+(?:[.,]\p{Nd}+)*(?:/\p{Nd}+)?", 0))


def integer_answer(c: Column, most: int = 999) -> Column:
    """A whole number from 0 to ``most``: the first in the box, else the first after ``Answer:``, else after 'the answer is',
    else the last of up to three digits; null without one."""
    fit = lambda x: F.when(plain_digits(x).try_cast("decimal(38,0)") <= most, plain_digits(x).try_cast("int"))
    number = r"\p{Nd}+"
    edge = r"(?![\p{L}\p{N}_])"
    return F.coalesce(
        fit(_first(boxed(c), number, 0)), fit(_first(answer_field(c), number, 0)), fit(_first(c, rf"(?i)the answer is(?U:\s)+(\p{{Nd}}{{1,3}}){edge}")),
        fit(_last(c, rf"(?<![\p{{L}}\p{{N}}_])(\p{{Nd}}{{1,3}}){edge}")),
    )


def grid(c: Column) -> Column:
    """The first nested list of whole numbers of a text, parsed; null without one or where it isn't JSON."""
    return F.from_json(_first(c, r"(?U)(\[\s*\[[\d\s,\[\]]+\]\s*\])"), "array<array<bigint>>")


def same_letter(response: Column, expected: Column) -> Column:
    """Null where no letter is found."""
    return choice(response) == F.regexp_replace(F.upper(strip(expected)), r"\A[()]+|[()]+\z", "")


def verify_math(response: Column, expected: Column) -> Column:
    return math_equal(stated_answer(response), expected)


def verify_integer(response: Column, expected: Column) -> Column:
    return integer_answer(response) == plain_digits(expected).try_cast("int")


def verify_mixed(response: Column, expected: Column, kind: Column) -> Column:
    """By letter where a choice is asked for; else the stated answer or last line as mathematics' normal form, or one that
    holds an expected text of three signs or more."""
    gold = strip(expected)
    said = F.coalesce(answer_field(response), strip(F.substring_index(strip(response), "\n", -1)))
    free = (plain_math(said) == plain_math(gold)) | ((F.length(gold) > 2) & F.contains(F.lower(said), F.lower(gold)))
    return F.when((F.coalesce(kind, F.lit("")) == "multiple_choice") | gold.rlike(r"\A[A-Z]\z"), same_letter(response, expected)).otherwise(free)


def verify_phrase(response: Column, expected: Column) -> Column:
    """What follows 'the answer is', to the full stop or the end: a letter, a word of yes or no, or a normal form."""
    gold = strip(expected)
    told = strip(_first(response, r"(?i)(?:the answer is|the answer:|the final answer:)(?U:\s)*([^\n]+?)(?:\.|\n?\z)"))
    said = strip(F.regexp_replace(strip(F.coalesce(told, answer_field(response))), r"\A[()]+|[()]+\z", ""))
    letter = F.upper(F.regexp_replace(said, r"\A[()]+|[()]+\z", ""))
    asked = F.regexp_replace(gold, r"[()]", "")
    return (
        F.when(gold.rlike(r"\A\(?[A-Z]\)?\z") & letter.rlike(r"\A\p{L}\z"), letter == asked)
        .when(F.lower(gold).isin(YES_NO_ANSWERS), F.lower(said) == F.lower(gold))
        .otherwise(plain_math(said) == plain_math(gold))
    )


def verify_grid(response: Column, expected: Column) -> Column:
    return grid(response) == F.from_json(expected, "array<array<bigint>>")


def verify(kind: Column, response: Column, expected: Column, answer_type: Column) -> Column:
    """By the kind of question. Programs are taken out by ``code_block`` but not run: theirs is null."""
    return (
        F.when(kind == "math", verify_math(response, expected))
        .when(kind == "choice", same_letter(response, expected))
        .when(kind == "integer", verify_integer(response, expected))
        .when(kind == "mixed", verify_mixed(response, expected, answer_type))
        .when(kind == "phrase", verify_phrase(response, expected))
        .when(kind == "grid", verify_grid(response, expected))
    )


def verdict(c: Column) -> Column:
    """0, 1 or null from a judge's reply: 'incorrect' is looked for before 'correct'."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("incorrect")), 0).when(F.contains(low, F.lit("correct")), 1)


def two_labels(c: Column) -> Column:
    """The first two whole numbers of a reply, each less one; null unless there are two."""
    found = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(found) >= 2, F.transform(F.slice(found, 1, 2), lambda x: x.try_cast("int") - 1))


def yes_no(c: Column) -> Column:
    low = F.upper(F.trim(c))
    return F.when(low.startswith("YES"), F.lit(True)).when(low.startswith("NO"), F.lit(False))


def named_in(c: Column, names: list[str]) -> Column:
    """The first of the names, in their order, that a reply contains, case ignored."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names])


def relation(c: Column, names: list[str]) -> Column:
    """The first word of a reply that is one of the names, case and marks at its end ignored; spelt as in the list."""
    words = F.transform(F.split(strip(c), r"(?U)[\s,;]+"), lambda w: F.upper(F.regexp_replace(w, r"[.,!?;:'\"]+\z", "")))
    known = F.create_map(*[F.lit(x) for n in names for x in (n.upper(), n)])
    return F.try_element_at(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda n: n.isNotNull()), F.lit(1))


def scope(c: Column, names: tuple[str, ...] = ("SUB_PROBLEM", "LOCAL", "GLOBAL"), otherwise: str = "UNCLEAR") -> Column:
    """The scope that a reply's first JSON object names, else the first of the names that it holds as a word."""
    said = F.upper(strip(F.get_json_object(_first(c, r"\{[^{}]*\}", 0), "$.scope")))
    said = F.replace(said, F.lit("SUBPROBLEM"), F.lit("SUB_PROBLEM"))
    words = [F.when(c.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_]){n}(?![\p{{L}}\p{{N}}_])"), F.lit(n)) for n in names]
    return F.when(c.isNotNull(), F.coalesce(F.when(said.isin(*names), said), *words, F.lit(otherwise)))


def cluster_blocks(c: Column) -> Column:
    """Array of (cluster, name, description) from a reply's blocks, parted by ``---``; those without number or name are left out."""
    line = lambda b, key, what: _first(b, rf"{key}:(?U:\s)*({what})")
    found = F.transform(
        F.split(c, r"\n---\n?"),
        lambda b: F.struct(
            line(b, "CLUSTER", r"\p{Nd}+").try_cast("int").alias("cluster"), F.upper(strip(line(b, "NAME", r"[^\n]+"))).alias("name"), F.coalesce(strip(line(b, "DESCRIPTION", r"[^\n]+")), F.lit("")).alias("description")
        ),
    )
    return F.filter(found, lambda x: x["cluster"].isNotNull() & x["name"].isNotNull())


def without_fences(c: Column) -> Column:
    """Code without the fences around it; null where nothing is left."""
    bare = F.regexp_replace(strip(c), r"(?i)\A```(?:python)?(?U:\s)*?\n?", "")
    return F.nullif(strip(F.regexp_replace(strip(bare), r"\n?```(?U:\s)*\z", "")), F.lit(""))
