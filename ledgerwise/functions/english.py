"""English words as full-text search knows them: stop words go, others become their Snowball stem."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that aren't indexed. Fixed values.
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor
not only own same so than too very s t can will just don should now""".split())
#: Words with a stem of their own, and words that no step changes once their plural is off. Fixed values.
OWN = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what they become, the longest that fits first. Fixed values.
STEP_2 = [x.split(":") for x in "ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble ogi:og li:".split()]
STEP_3 = [x.split(":") for x in "ational:ate tional:tion alize:al icate:ic iciti:ic ative: ical:ic ness: ful:".split()]
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_VOWEL = "aeiouy"
_SHORT = re.compile(rf"(?:^|.*[^{_VOWEL}])[{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$")
_REGION = re.compile(rf".*?[{_VOWEL}][^{_VOWEL}]")


def _region(word: str, at: int = 0) -> int:
    """Where the part behind the first consonant after a vowel begins."""
    found = _REGION.match(word, at)
    return found.end() if found else len(word)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with other letters than a-z and the apostrophe stay."""
    if not re.fullmatch("[a-z']+", word) or len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in OWN:
        return OWN[word]
    word = re.sub(rf"(^|(?<=[{_VOWEL}]))y", "Y", word)
    begin = re.match("gener|commun|arsen", word)
    r1 = begin.end() if begin else _region(word)
    r2 = _region(word, r1)
    word = re.sub("('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWEL}].*.s$", word):
        word = word[:-1]
    if word in KEPT:
        return word
    # past tense and participles
    if found := re.search("(eedly|eed)$", word):
        if found.start() >= r1:
            word = word[: found.start()] + "ee"
    elif (found := re.search("(ingly|edly|ing|ed)$", word)) and re.search(f"[{_VOWEL}]", word[: found.start()]):
        word = word[: found.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.match(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    for ending, into in STEP_2:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r1 and (ending != "ogi" or word[at - 1 : at] == "l") and (ending != "li" or word[at - 1 : at] in tuple("cdeghkmnrt")):
                word = word[:at] + into
            break
    for ending, into in STEP_3:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= (r2 if ending == "ative" else r1):
                word = word[:at] + into
            break
    for ending in STEP_4:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.match(word[:-1]))) or word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.lower()


def _stems(words: pd.Series) -> pd.Series:
    return words.map({w: None if w in STOP_WORDS else stem(w) for w in words.dropna().unique()})


def stems(words) -> Column:
    """Stems of lower-case words, null for stop words; each different word of a batch is looked at once."""
    return F.pandas_udf(_stems, "string")(words)
