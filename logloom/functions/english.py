"""English words for search: the stop words, and the stem of a word by the published second version of the Porter algorithm."""

from __future__ import annotations

import re

#: Words that searches pass over.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, and words that stay once their plural is off.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
FINISHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings of the second, third and fourth step, and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

# a vowel is one of aeiouy; a y that begins a word or follows a vowel is written Y, and is none
REGION = re.compile(r"[aeiouy][^aeiouy]")
PREFIX = re.compile(r"gener|commun|arsen")
VOWEL = re.compile(r"[aeiouy]")
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])\Z")
DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")


def regions(word: str) -> tuple[int, int]:
    """Where the word's two regions begin: behind the first consonant after a vowel, and the same inside that region."""
    start = PREFIX.match(word) or REGION.search(word)
    first = start.end() if start else len(word)
    again = REGION.search(word, first)
    return first, again.end() if again else len(word)


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def without_plural(word: str) -> str:
    ending = longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        return word[:-2]
    if ending in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if ending == "s" and VOWEL.search(word[:-2]) else word


def without_past(word: str, first: int) -> str:
    ending = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    rest = word.removesuffix(ending)
    if ending in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= first else word
    if not VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= first and SHORT.search(rest) else rest


def replaced(word: str, endings: dict[str, str], least: int, fits=lambda ending, rest: True) -> str:
    """The word with its longest ending exchanged, if that lies behind `least` and fits."""
    if (ending := longest(word, endings)) is None:
        return word
    rest = word.removesuffix(ending)
    return rest + endings[ending] if len(rest) >= least and fits(ending, rest) else word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or word in OWN_STEMS:
        return OWN_STEMS.get(word, word)
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    first, second = regions(word)
    word = without_plural(re.sub(r"'(?:s'?)?\Z", "", word))
    if word in FINISHED:
        return word
    word = without_past(word, first)
    if len(word) > 2 and word[-1] in "yY" and not VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = replaced(word, SECOND, first, lambda e, rest: {"ogi": rest[-1:] == "l", "li": rest[-1:] in tuple("cdeghkmnrt")}.get(e, True))
    word = replaced(word, THIRD, first, lambda e, rest: e != "ative" or len(rest) >= second)
    word = replaced(word, FOURTH, second, lambda e, rest: e != "ion" or rest[-1:] in ("s", "t"))
    if word.endswith("e") and (len(word) > second or len(word) > first and not SHORT.search(word[:-1])) or word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.replace("Y", "y")


WORD = re.compile(r"[^\W_]+")


def lexemes(text: str | None) -> set[str]:
    """Stems of a text's words, stop words aside; an apostrophe parts words."""
    return {stem(w) for w in WORD.findall((text or "").lower()) if w not in STOP_WORDS}


def common_start(lexeme: str) -> str:
    """What every word of this stem begins with: algorithm and exceptions change no more than the last two letters that are left."""
    return lexeme[:-2] if len(lexeme) > 3 else lexeme[:1]
