"""Segmentation rule tables: ordered break and no-break pairs per language.

A rule is (break?, before, after): ``before`` must match the text that ends at a position, ``after`` the text that begins
there. Tables are cascaded: that of the words' language comes first, or, where no language can be told, those of all
languages written in their script; then the table of abbreviations that several languages share and the general one. The
first rule whose two sides match decides the position.
"""

from __future__ import annotations

import regex

BREAK, KEEP = True, False

# Abbreviations, by language. ``always`` never end a sentence, ``number`` not before a number,
# ``lower`` not before a lower-case word, a number or a bracket.
ABBREVIATIONS: dict[str, dict[str, str]] = {
    "en": {
        "always": "Dr Prof Mr Mrs Ms Messrs Rev Hon Gen Col Sgt Capt Lt St Mt vs cf Cf viz i.e I.e e.g E.g approx Approx resp esp incl "
        "Sec Secs Eq Eqs Fig Figs Ch Chap Thm Lem Prop Cor Def Vol Vols pp ff al ed eds et a.k.a c.f w.r.t",
        "number": "ca No no Nos nos p P Art art Ex ex Ref ref Tab Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
        "lower": "etc a.m p.m U.K U.S U.N E.U Inc Ltd Co Corp Jr Sr dept est max min",
    },
    "de": {
        "always": "Dr Prof Hr Fr Hrn Gl Gln Abb Abs Kap Bd Nr Nrn z.B z. B d.h d. h u.a u. a o.B.d.A vgl Vgl bzw ca evtl ggf inkl sog insb Aufg Bsp Tab Abschn Def Lem bspw",
        "number": "S Art",
        "lower": "usw etc u.s.w usf",
    },
    "fr": {
        "always": "M MM Mme Mlle Mgr Me Dr Pr éq Éq éqs fig Fig p.ex p. ex c.-à-d cf Cf env chap Chap vol Vol sec Sec ex Ex réf art n.b",
        "number": "p pp n no",
        "lower": "etc av apr",
    },
    "es": {
        "always": "Sr Sra Srta Srs Sres Dr Dra Prof D Dña ec Ec ecs fig Fig p.ej p. ej pág Pág págs cap Cap vol Vol núm Núm aprox vid cf Cf Ud Uds ej Ej",
        "number": "p pp n art",
        "lower": "etc",
    },
    "pt": {
        "always": "Sr Sra Srs Dr Dra Prof Profa eq Eq eqs fig Fig p.ex p. ex pág págs cap Cap vol Vol núm aprox cf Cf ex Ex",
        "number": "p pp n art",
        "lower": "etc",
    },
    "it": {
        "always": "sig Sig sig.ra Sig.ra sigg Dott dott dott.ssa Prof prof ing avv eq Eq fig Fig p.es p. es pag pagg cap Cap vol Vol num cfr Cfr es Es",
        "number": "p pp n art",
        "lower": "ecc etc",
    },
    "nl": {
        "always": "dr Dr drs mr ir ing prof Prof dhr Dhr mevr Mevr mw verg Verg vgl fig Fig afb Afb bijv Bijv bv d.w.z D.w.z d.i m.a.w o.a nl i.p.v t.o.v nr Nr blz hfst ca resp hr Hr",
        "number": "p pp art",
        "lower": "enz etc",
    },
    "ru": {
        "always": "т.е т. е т.к т. к ур Ур рис Рис см См ср Ср напр Напр гл Гл табл Табл им проф Проф д-р Д-р акад доц г-н г-жа ул стр Стр п пп №№ разд теор опр",
        "number": "г с ст",
        "lower": "т.д т. д т.п т. п др пр и др",
    },
    "uk": {
        "always": "т.б т. б тобто рів Рів рівн мал Мал рис Рис див Див пор Пор напр Напр гл Гл табл Табл ім проф Проф д-р Д-р акад доц вул стор Стор п пп розд теор озн п-н п. н",
        "number": "р с ст",
        "lower": "т.д т. д т.п т. п ін тощо",
    },
    "ar": {"always": "د أ ص م ش", "number": "", "lower": "إلخ الخ"},
    "hi": {"always": "डॉ श्री प्रो सु उदा समी", "number": "पृ", "lower": "आदि"},
    "ko": {"always": "Dr", "number": "", "lower": ""},
}

#: Abbreviations met in all languages of the Latin script.
SHARED = {"always": "al cf Cf vs Dr Prof", "number": "ca", "lower": "etc"}

#: Languages by the script whose letters they are written with.
TABLES_BY_SCRIPT = {
    "latin": ("en", "de", "fr", "es", "pt", "it", "nl"),
    "cyrillic": ("ru", "uk", "en"),
    "arabic": ("ar", "en"),
    "devanagari": ("hi", "en"),
    "other": ("en",),
}

TERMINATORS = ".!?…。！？｡．।॥؟۔"
CLOSERS = "\"'’”»“」』）)\\]】》*_"

# The last rules of the German table: ordinals, which a capital may follow.
_BEFORE_ORDINALS = "am im vom zum beim der die das dem den des jeder jedem jeden ein einem bis seit nach ab".split()
_GERMAN_ORDINAL = rf"(?i:\b(?:{'|'.join(_BEFORE_ORDINALS)}))\s+\d{{1,4}}\."
# An answer letter after these words isn't an initial.
_ANSWERS = r"(?i:(?:is|are|gives|answer|option|choice|ist|lautet|est|es|é|è|respuesta|réponse|antwort|ответ)\s*:?\s*)"


def _alternation(words: str) -> str:
    """Abbreviations as one pattern. Blanks in the list separate them, but for those of one letter after a dot ('d. h')."""
    parts: list[str] = []
    for w in words.split():
        if parts and parts[-1].endswith("."):
            parts[-1] += " " + w
        elif parts and w[:1].islower() and len(w) == 1 and parts[-1] in ("и",):
            parts[-1] += " " + w
        else:
            parts.append(w)
    return "|".join(regex.escape(p, special_only=True).replace("\\ ", r"\s*").replace(" ", r"\s*") for p in sorted(set(parts), key=lambda p: (-len(p), p)))


def _language_rules(lang: str) -> list[tuple[bool, str, str]]:
    words = SHARED if lang == "shared" else ABBREVIATIONS[lang]
    rules = []
    edge = r"(?<![\p{L}\p{N}])"
    if words["always"]:
        rules.append((KEEP, rf"{edge}(?:{_alternation(words['always'])})\.", r"(?!\s*\n\s*\n)"))
    if words["number"]:
        rules.append((KEEP, rf"{edge}(?:{_alternation(words['number'])})\.", r"\s*[\p{N}(]"))
    if words["lower"]:
        rules.append((KEEP, rf"{edge}(?:{_alternation(words['lower'])})\.", r"\s*[\p{Ll}\p{N}(\[,;:–-]"))
    if lang == "de":
        rules.append((KEEP, _GERMAN_ORDINAL, r"\s+\p{Lu}"))
    return rules


#: The general table. Closing marks stand on the side of ``before``.
GENERAL: list[tuple[bool, str, str]] = [
    (KEEP, r"(?<![\p{L}\p{N}])\p{L}\.", r"\s?\p{L}{1,2}\."),  # within 'z. B.', 'p. ex.'
    (KEEP, r"\.", r"\p{Nd}"),  # decimals, versions
    (KEEP, r"(?:\.\.+|…)", r"(?!\s*\n)"),  # dots of hesitation
    (KEEP, r"(?:\.\.+|…)", r"\s*\n\s*\p{Ll}"),
    (KEEP, rf"(?<!{_ANSWERS})(?<![\p{{L}}\p{{N}}])(?:\p{{Lu}}\.[\s-]?)*\p{{Lu}}\.", r"\s*[\p{L}(,;]"),  # initials
    (KEEP, r"(?i:\b(?:sec|eq|fig|no|nr|vol|ch|art|gl|abb|nach))\.?\s+\p{Nd}+\.", r"\s+\p{Ll}"),  # 'Sec. 4. of'
    (KEEP, r"[.!?…]", r"[\p{Ll}\p{Nd}_/=&#@%\\-]"),  # names of files and functions, addresses
    (KEEP, r"[.!?…](?:[\"'”’»“)\]*_])+", r"[\p{Ll}\p{Nd}_/=&#@%\\-]"),
    (KEEP, r".", r"\s*(?:[,;:%)\]،；，、：]|[=<>+/×·](?:\s|\p{Nd}))"),
    (KEEP, r"[.!?…。！？؟।]\s?[\"'”’»“]+[*_]*", r"\s*\p{Ll}"),  # a quotation within a sentence that goes on
    (KEEP, r"[。！？!?.][」』”’]", r"\s*(?:と|って|という|は|を|に|が|の|で|も|など|的|地|这|時)(?![一-鿿]*[：:])"),
    (BREAK, r"[。！？｡．।॥؟۔]\s?[\"'’”»“」』）)\]】》*_]*", r""),
    (BREAK, r"(?:[\p{Ll}\p{N}\p{Lo}]{2}|[\p{N})\]}$`%»”\"!?])[.!?]+[\"'’”»)\]*_]*", r"[\p{Lu}\p{Lo}¿¡\"“«„(\[]"),  # no blank between
    (BREAK, r"[.!?…][\"'’”»“」』）)\]】》*_]*", r"\s"),
    (BREAK, r".", r"\Z"),
]


class Cascade:
    """The tables of some languages, then the general one. Neighbouring rules of one kind are tried as one pattern."""

    last_word, ordinal = regex.compile(r"(?r)(?:\p{L}+|\p{Nd})"), regex.compile(f"(?r){_GERMAN_ORDINAL}")

    def __init__(self, languages: tuple[str, ...]):
        rules = [r for lang in languages for r in _language_rules(lang)] + GENERAL
        merged: list[tuple[bool, list[str], str]] = []
        by_after: dict[tuple[bool, str], list[str]] = {}
        n_language = len(rules) - len(GENERAL)
        for i, (kind, before, after) in enumerate(rules):
            if i < n_language and (kind, after) in by_after:
                by_after[kind, after].append(before)
                continue
            side = [before]
            if i < n_language:
                by_after[kind, after] = side
            merged.append((kind, side, after))
        # read backwards from the position, so each side is tried at one place only
        self.rules = [(kind, regex.compile("(?r)(?:" + "|".join(side) + ")"), regex.compile(after)) for kind, side, after in merged]

        #: words that some rule names: a mark after any other word of letters is decided by what follows
        tables = [SHARED if lang == "shared" else ABBREVIATIONS[lang] for lang in languages]
        self.named = {part for words in tables for listed in words.values() for w in listed.split() for part in w.replace("-", ".").split(".")}

    def breaks(self, text: str, low: int, at: int) -> bool:
        """Whether a mark with its closing marks ends a unit at ``at``; ``low`` is the unit's start, as far as rules look back."""
        for kind, left, right in self.rules:
            if right.match(text, at) and left.match(text, low, at):
                return kind
        return False

    def hangs_on_language(self, text: str, low: int, mark: int) -> bool:
        """Whether the word before a mark is one that only some languages' tables name, or a number, as German ordinals are."""
        word = self.last_word.match(text, low, mark)
        if not word:
            return False
        return word[0] in self.named if word[0][-1].isalpha() else bool(self.ordinal.match(text, low, mark + 1))

    def plain(self, text: str, low: int, mark: int, at: int) -> bool | None:
        """What the tables say of a single mark in a plain place, without trying them; None elsewhere."""
        c, nxt = text[mark], text[at : at + 1]
        if c == "." and (nxt.isdigit() or nxt.islower()):
            return False
        if c in "。！？।":
            return True if nxt.isalpha() and nxt > "\u2e80" else None
        if c == "…" or not nxt.isspace() or not text[at + 1 : at + 2].isalpha():
            return None
        if c in "!?":
            return True
        tokens = text[max(low, mark - 40) : mark].rsplit(None, 1)
        if not tokens:
            return None
        word = tokens[-1]
        if word.isalpha():
            # no rule of the tables can keep a word of two letters or more that none of them names
            return True if len(word) > 1 and word not in self.named else None
        if word.isdigit():
            # before a capital only a German ordinal goes on, after one of a few words
            rest = tokens[0].rsplit(None, 1) if len(tokens) > 1 else []
            return True if len(rest) > 1 and rest[-1].isalpha() and not text[at + 1].islower() and rest[-1].lower() not in _BEFORE_ORDINALS else None
        return True if word[-1].isdigit() and ("." in word or "," in word) and word[0].isdigit() else None


_CASCADES: dict[tuple[str, str | None], Cascade] = {}


def cascade_for(script: str, language: str | None = None) -> Cascade:
    """The tables of a language, or of all languages of a script."""
    if (script, language) not in _CASCADES:
        own = TABLES_BY_SCRIPT[script] if language is None else (language,)
        _CASCADES[script, language] = Cascade((*own, "shared") if script in ("latin", "cyrillic") else own)
    return _CASCADES[script, language]
