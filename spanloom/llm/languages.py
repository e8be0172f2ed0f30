"""What tells languages apart: scripts and everyday words.

Fixed values, stated as text. The words are function words and others of everyday use, in lower case.
"""

from __future__ import annotations

import re

WORDS: dict[str, str] = {
    "en": "a stand then past toward near loses how many remain find sum kept count label divides day hours resets the of and to in is that it "
    "for was as with be by on not are this which or from at but have an they you were their has been its will would there what about if "
    "more when can who so out up we let into only than other each all must no may some i my me he she his her do does did these those "
    "because between every same both",
    "de": "wie viele bleiben im ort trägt jede tauscht gegen aus wer besitzt schenkt davon stehen tag verliert wieder zwischen den ersten zahl "
    "wäre zuerst angenommen ergebnis steht heißt folgt aufgabe bleibt liegt ist der die das und in zu von mit sich des auf für dem nicht "
    "ein eine als auch es an werden er hat dass sie nach wird bei einer um am sind noch einem über so zum war haben nur oder aber vor "
    "zur bis mehr durch man sein wenn ich nein wir muss hier kann also genau keine gar ob dann diese was immer schon",
    "fr": "après sous avant chez sans d'après selon a d' l' qu' j' n' c' s' qui possède donne chaque porte encore perd échange contre combien jour le entre dressent plaques fines poteaux attends supposons "
    "égale réponse énoncé appelle se trouve regarde pose vaut exactement faut recalculer veut contient peut prendre dépasse vraiment à "
    "la les de des du et en un une est que dans pour pas par sur au aux avec ne ce il elle sont plus mais ou nous vous je son sa ses "
    "cette ces être fait comme tout si leur bien donc alors ici non d'abord c'est l'on on y dit soit depuis cela dire reste très même où",
    "es": "a cambia cuentas quien tiene regala entre hay postes cuántas quedan día pierde otras finas cada lleva placas supongamos espera "
    "entonces vale exactamente significa primero miro tomo está según queda debajo llama calcular otra vez realmente mayor igual el la "
    "los las de del y en un una es que por con para no se su al lo como más pero sus le ya o este sí porque esta cuando muy sin sobre "
    "también me hasta donde desde todo nos durante uno ni eso ese aquí fuera si sea dice son ser qué yo así",
    "pt": "troca contas quem tem dá entre há postes quantas restam dia perde outras finas cada leva placas suponha espere então vale "
    "exatamente quer dizer primeiro vejo ponho está fica abaixo chama isso calcular mesmo maior igual preciso enunciado muda o a os as "
    "de do da dos das e em um uma é que por com para não se no na nos nas ao à mais como mas foi ele ela esta este quando muito sem "
    "sobre também até onde desde tudo nem esse aqui outra seja são ser já depois pela pelo só pode qual eu você",
    "it": "a l' d' un' all' dell' nell' c' scambia perle chi possiede regala tra ci sono pali quante restano giorno perde altre fini ogni porta lastre supponiamo aspetta "
    "allora vale esattamente significa prima guardo pongo trova resta sotto chiama calcolare altra volta davvero maggiore uguale "
    "risposta il lo la i gli le di del della dei delle e in un una è che per con non si su al alla come più ma anche se da nel nella "
    "questo questa quando molto senza sopra fino dove tutto né qui sia ha già dopo dal dalla cosa poi quindi solo devo fra fosse perché "
    "io ciò",
    "nl": "ruilt kralen wie bezit geeft staan palen hoeveel blijven dag verliest weer fijne elke draagt platen stel wacht dan precies betekent "
    "eerst bekijk neem ligt blijft onder noemt opnieuw uitrekenen echt groter gelijk antwoord volgens klopt de het een en van in is dat "
    "op te zijn met voor niet aan er om maar ook als bij door naar uit nog wel ze hij was wordt worden over tot kan moet geen meer dit "
    "die ik we hier dus tussen nee nu zo heeft of heb zou hoe wat deze omdat",
    "ru": "и в не на что с по как это но а к из у за от же то так для он она мы вы они его её их если бы был была нет да только меньше больше "
    "чем когда здесь или ещё при до об все всё между потому случай нужно равна равен значит",
    "uk": "і в не на що з за як це але а до із у від же то так для він вона ми ви вони його її їх якщо би був була ні та лише менше більше ніж "
    "коли тут або ще при про всі все між тому випадок треба дорівнює отже є й чи потрібно",
}

#: Unicode scripts and the languages of this project that are written in them.
SCRIPT_LANGUAGES = {
    "Latin": ["en", "de", "fr", "es", "pt", "it", "nl"],
    "Cyrillic": ["ru", "uk"],
    "Arabic": ["ar"],
    "Devanagari": ["hi"],
    "Hangul": ["ko"],
    "Thai": ["th"],
    "Kana": ["ja"],
    "Han": ["zh", "ja"],
}

#: English names and three-letter codes of the languages.
NAMES = {
    "en": "english eng", "de": "german deu ger deutsch", "fr": "french fra fre français francais", "es": "spanish spa español espanol castilian", "pt": "portuguese por português",
    "it": "italian ita italiano", "nl": "dutch nld dut nederlands flemish", "ru": "russian rus русский", "uk": "ukrainian ukr українська", "ar": "arabic ara العربية", "hi": "hindi hin हिन्दी",
    "ko": "korean kor 한국어", "th": "thai tha ไทย", "ja": "japanese jpn 日本語", "zh": "chinese zho chi mandarin cmn 中文",
}


#: Letters that tell languages of the Latin script apart.
LETTERS = {"de": "äöüß", "fr": "éèêàçùîôœë", "es": "ñ¿¡óíáú", "pt": "ãõçáâêéó", "it": "òàèìù", "nl": "ë"}


def word_weights() -> dict[str, list[tuple[str, float]]]:
    """word -> (language, weight): a word's weight is shared by the languages whose list holds it."""
    held: dict[str, list[str]] = {}
    for lang, text in WORDS.items():
        for w in dict.fromkeys(text.split()):
            held.setdefault(w, []).append(lang)
    return {w: [(lang, 1 / len(langs)) for lang in langs] for w, langs in held.items()}


LATIN = ("en", "de", "fr", "es", "pt", "it", "nl")
_LATIN_WORDS = re.compile("[a-zß-öø-ɏ']+")
_LATIN_WEIGHTS = {w: [x for x in langs if x[0] in LATIN] for w, langs in word_weights().items()}


def latin_language(low: str, ratio: float = 1.7, least: float = 2) -> str | None:
    """The language of a lower-case text in Latin letters by its everyday words and letters; None where too few tell it apart.

    A word with an apostrophe also counts by its two parts.
    """
    hits = dict.fromkeys(LATIN, 0.0)
    for w in _LATIN_WORDS.findall(low):
        for lang, weight in _LATIN_WEIGHTS.get(w, ()):
            hits[lang] += weight
        if "'" in w:
            at = w.index("'") + 1
            for part in (w[:at], w[at:]):
                for lang, weight in _LATIN_WEIGHTS.get(part, ()):
                    hits[lang] += weight
    if not low.isascii():
        for lang, letters in LETTERS.items():
            hits[lang] += 0.5 * sum(low.count(c) for c in letters)
    best = max(hits, key=hits.get)
    rest = max(v for k, v in hits.items() if k != best)
    return best if hits[best] >= least and hits[best] >= ratio * rest else None


def cyrillic_language(text: str) -> str | None:
    """Russian or Ukrainian by the letters that only one of them has; None where neither shows."""
    uk, ru = sum(c in "іїєґІЇЄҐ" for c in text), sum(c in "ыэъёЫЭЪЁ" for c in text)
    return "uk" if uk > ru else "ru" if ru > uk else None
