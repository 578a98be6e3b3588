"""The Porter2 (English) stemming algorithm, from its published description."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    after = re.compile(r"[aeiouy][^aeiouy]")
    if m:
        r1 = m.end()
    else:
        found = after.search(w)
        r1 = found.end() if found else len(w)
    found = after.search(w, r1)
    return r1, found.end() if found else len(w)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS and w[-1] not in "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


def stem(word: str) -> str:
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in INVARIANT:
        return w
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eedly", "eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for s, t in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in tuple(LI)):
                w = w[: -len(s)] + t
            break
    # 3
    for s, t in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ative" and len(w) - len(s) < r2):
                w = w[: -len(s)] + t
            break
    # 4
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
