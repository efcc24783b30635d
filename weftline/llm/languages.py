"""Which language a short text is in: by script, else by function words."""

from __future__ import annotations

import re
from collections import Counter

#: Function words of four languages (articles, prepositions, pronouns, auxiliaries, conjunctions).
FUNCTION_WORDS = {
    "en": "above below near along beside besides against during through down up out off within without upon toward across around another such same more most very first second next last far still while until the of and to in is are was were be been that this these those it its with for from as at by on or not which who whose when where how what than then so if has have had do does can could must may will would each any all only into between after before because since over under no nor but we you i he she they his her their our your here there also about",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren wird werden wurde hat haben hatte mit von vom zu zum zur im in an am auf für als wie wenn dass daß weil nach bei aus über unter zwischen durch sich es er sie wir man kein keine auch nur noch so um je jede jeden jeder jedes welche welcher wieviele viele also damit dann dabei bis",
    "fr": "le la les un une des du de et ou mais ne pas est sont était être a ont avait avec pour par dans sur sous entre que qui quand où dont ce cet cette ces se sa son ses leur leurs au aux en il elle ils elles on nous vous je si comme donc car chaque tout tous toute plus moins aussi alors après avant sans quel quelle quels combien reste d l s n qu",
    "es": "el la los las un una unos unas de del y o pero no es son era fue ser ha han había con por para en sobre entre que quien cuando donde cuyo cual cuál cuánto cuántos cuántas este esta estos estas se su sus le les al lo como si porque cada todo todos toda más menos también entonces después antes sin a hay e ni",
}
#: Function words of further languages that the four above don't have.
FURTHER_WORDS = {
    "it": "che di della delle degli dei nel nella nelle sono è perché gli più questo questa anche quando quindi dove ogni cui alla dalla con il lo uno",
    "pt": "não uma um são é os das dos pela pelo também quando então cada mais isso este ou ao à com em na no nas nos seu sua",
    "nl": "het een niet zijn wordt worden van voor met aan deze dit maar ook dan naar uit bij hoeveel elke geen wij",
    "pl": "nie się jest są to że na do przez dla oraz jak który która które każdy tylko ale jego od po więc ile",
    "sv": "och att det som är av på för inte ett den med till har om vi varje hur många eller",
}
_OF: dict[str, set[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _OF.setdefault(_w, set()).add(_lang)
FUNCTION = frozenset(_OF)
_FURTHER: dict[str, set[str]] = {}
for _lang, _list in FURTHER_WORDS.items():
    for _w in set(_list.split()) - FUNCTION:
        _FURTHER.setdefault(_w, set()).add(_lang)

_MATH = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$|\$[^$\n]*\$|```.*?```", re.S)
_WORD = re.compile(r"[^\W\d_]+")
#: First and last code points of scripts told apart.
SCRIPTS = {"zh": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)), "ja": ((0x3040, 0x30FF),), "ko": ((0xAC00, 0xD7AF),), "ru": ((0x0400, 0x04FF),), "el": ((0x0370, 0x03FF),), "ar": ((0x0600, 0x06FF),), "he": ((0x0590, 0x05FF),), "hi": ((0x0900, 0x097F),), "th": ((0x0E00, 0x0E7F),)}


def words(text: str) -> list[str]:
    """Lower-cased words of letters, formulas and code left out."""
    return _WORD.findall(_MATH.sub(" ", text).lower())


def counts(text: str) -> tuple[Counter, int]:
    """How many characters (other scripts) or function words (Latin script) speak for each language; number of words. A word of several languages speaks for each in part."""
    score: Counter = Counter()
    found = words(text)
    letters = "".join(found)
    other = Counter()
    for ch in letters:
        o = ord(ch)
        if o > 0x36F:
            for lang, ranges in SCRIPTS.items():
                if any(a <= o <= b for a, b in ranges):
                    other[lang] += 1
                    break
    if letters and sum(other.values()) > 0.3 * len(letters):
        score.update(other)
        if other["ja"]:
            score["ja"] += other["zh"]
        return score, len(found)
    for w in found:
        langs = _OF.get(w)
        if langs:
            for lang in langs:
                score[lang] += 1 / len(langs)
        if "ß" in w or "ä" in w or "ü" in w:
            score["de"] += 0.5
        if "ñ" in w or "ó" in w or "í" in w or "ú" in w:
            score["es"] += 0.5
        if "è" in w or "ê" in w or "ç" in w or "œ" in w:
            score["fr"] += 0.5
    return score, len(found)


def language(text: str, least: float = 1.5, lead: float = 1.6) -> str | None:
    """The language of a text, None if it has too few telling words or two languages come close."""
    score, n = counts(text)
    best = max(score.values(), default=0.0)
    if not any(k in SCRIPTS for k in score):
        further: Counter = Counter()
        for w in words(text):
            for lang in _FURTHER.get(w, ()):
                further[lang] += 1 / len(_FURTHER[w])
        # Another language must say more in words of its own than any of the four in all of theirs.
        score.update({k: v for k, v in further.items() if v >= lead * best})
    if not score:
        return None
    (first, a), *rest = score.most_common(2)
    b = rest[0][1] if rest else 0.0
    return first if a >= least and a >= lead * b else None
