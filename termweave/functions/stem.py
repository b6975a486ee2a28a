"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

from functools import lru_cache

# The rule tables of the published algorithm (suffix, replacement).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _vowels(word: str) -> list[bool]:
    flags: list[bool] = []
    for i, ch in enumerate(word):
        flags.append(ch in "aeiou" or (ch == "y" and i > 0 and not flags[i - 1]))
    return flags


def _measure(stem: str) -> int:
    flags = _vowels(stem)
    return sum(1 for a, b in zip(flags, flags[1:]) if a and not b)


def _has_vowel(stem: str) -> bool:
    return any(_vowels(stem))


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _short_end(word: str) -> bool:
    if len(word) < 3 or word[-1] in "wxy":
        return False
    a, b, c = _vowels(word)[-3:]
    return not a and b and not c


def _longest(word: str, rules, least: int) -> str:
    fitting = [(s, r) for s, r in rules if word.endswith(s)]
    if not fitting:
        return word
    suffix, replacement = max(fitting, key=lambda rule: len(rule[0]))
    stem = word[: -len(suffix)]
    return stem + replacement if _measure(stem) > least else word


def _plural_and_past(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if not _has_vowel(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of one lower-case word; words of one or two characters are left alone."""
    if len(word) < 3:
        return word
    w = _plural_and_past(word)
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, STEP_2, 0)
    w = _longest(w, STEP_3, 0)
    endings = [s for s in STEP_4 if w.endswith(s)]
    if endings:
        stem = w[: -len(max(endings, key=len))]
        plain = not w.endswith("ion") or stem.endswith(("s", "t"))
        if _measure(stem) > 1 and plain:
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
