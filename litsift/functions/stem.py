"""English stemmer (the published Snowball "english" algorithm, also called Porter2).

A small per-word helper: ``stem(word)``. Spark calls it through the Arrow-batched
pandas UDF in :mod:`litsift.functions.text`, memoised per worker, so each distinct
token is stemmed once per Python worker.
"""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published algorithm.
_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_ENDING = frozenset("cdeghkmnrt")

_EXCEPTIONS_1 = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_EXCEPTIONS_2 = frozenset(
    ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])

_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"),
    ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"),
    ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"),
    ("lessli", "less"), ("li", ""),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"),
    ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""),
]
_STEP4 = ["ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ism", "ate",
          "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _is_vowel(ch: str) -> bool:
    return ch in _VOWELS


def _region(word: str, start: int) -> int:
    """Index after the first non-vowel that follows a vowel, from ``start``."""
    for i in range(start + 1, len(word)):
        if not _is_vowel(word[i]) and _is_vowel(word[i - 1]):
            return i + 1
    return len(word)


def _r1_r2(word: str) -> tuple[int, int]:
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _region(word, 0)
    r2 = _region(word, r1)
    return r1, r2


def _short_syllable_end(word: str) -> bool:
    n = len(word)
    if n == 2:
        return _is_vowel(word[0]) and not _is_vowel(word[1])
    if n >= 3:
        return (not _is_vowel(word[-3]) and _is_vowel(word[-2])
                and not _is_vowel(word[-1]) and word[-1] not in "wxY")
    return False


def _is_short(word: str, r1: int) -> bool:
    return r1 >= len(word) and _short_syllable_end(word)


def _has_vowel(s: str) -> bool:
    return any(_is_vowel(c) for c in s)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem one lower-case English word."""
    if word is None:
        return None
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS_1:
        return _EXCEPTIONS_1[word]
    w = word[1:] if word.startswith("'") else word
    if not w:
        return w
    # mark consonant y
    chars = list(w)
    if chars[0] == "y":
        chars[0] = "Y"
    for i in range(1, len(chars)):
        if chars[i] == "y" and chars[i - 1] in _VOWELS:
            chars[i] = "Y"
    w = "".join(chars)
    r1, r2 = _r1_r2(w)

    # step 0
    for suf in ("'s'", "'s", "'"):
        if w.endswith(suf):
            w = w[: -len(suf)]
            break

    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ied") or w.endswith("ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("us") or w.endswith("ss"):
        pass
    elif w.endswith("s"):
        if _has_vowel(w[:-2]):
            w = w[:-1]

    if w in _EXCEPTIONS_2:
        return w

    # step 1b
    for suf in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suf):
            if suf in ("eed", "eedly"):
                if len(w) - len(suf) >= r1:
                    w = w[: -len(suf)] + "ee"
            else:
                stem_part = w[: -len(suf)]
                if _has_vowel(stem_part):
                    w = stem_part
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif _is_short(w, r1):
                        w += "e"
            break

    # step 1c
    if len(w) > 2 and w[-1] in "yY" and not _is_vowel(w[-2]):
        w = w[:-1] + "i"

    # step 2
    for suf, rep in sorted(_STEP2, key=lambda p: -len(p[0])):
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ogi":
                    if len(w) > 3 and w[-4] == "l":
                        w = w[:-3] + "og"
                elif suf == "li":
                    if len(w) > 2 and w[-3] in _LI_ENDING:
                        w = w[:-2]
                else:
                    w = w[: -len(suf)] + rep
            break

    # step 3
    for suf, rep in sorted(_STEP3, key=lambda p: -len(p[0])):
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ative":
                    if len(w) - len(suf) >= r2:
                        w = w[:-5]
                else:
                    w = w[: -len(suf)] + rep
            break

    # step 4
    for suf in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suf):
            if len(w) - len(suf) >= r2:
                if suf == "ion":
                    if len(w) > 3 and w[-4] in "st":
                        w = w[:-3]
                else:
                    w = w[: -len(suf)]
            break

    # step 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l"):
        if len(w) - 1 >= r2 and len(w) > 1 and w[-2] == "l":
            w = w[:-1]

    return w.replace("Y", "y")
