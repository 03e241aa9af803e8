"""Porter's stemming algorithm, after the published description (M. F. Porter, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "aeiou"
# Suffix tables of the publication (fixed values): (suffix, replacement); the longest matching suffix decides.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """One letter per letter: c for consonants, v for vowels; a y is a vowel behind a consonant."""
    out = []
    for i, letter in enumerate(stem):
        vowel = letter in _VOWEL or (letter == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, table: tuple[tuple[str, str], ...], least: int) -> str:
    match = max((s for s in table if word.endswith(s[0])), key=lambda s: len(s[0]), default=None)
    if match and _measure(word[: -len(match[0])]) >= least:
        return word[: -len(match[0])] + match[1]
    return word


def _step1(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        stem = word[: -len(ending)]
        if word.endswith(ending) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


@lru_cache(100_000)
def stem_word(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay as they are."""
    if len(word) < 3:
        return word
    word = _step1(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, 1)
    word = _replace(word, _STEP3, 1)
    ending = max((s for s in _STEP4 if word.endswith(s)), key=len, default="")
    if ending:
        stem = word[: -len(ending)]
        if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
