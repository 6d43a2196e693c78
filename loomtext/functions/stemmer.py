"""The Porter stemmer, after the published algorithm: five steps of suffix rules over the measure of a stem."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_LETTERS = str.maketrans({chr(i): "y" if chr(i) == "y" else "v" if chr(i) in "aeiou" else "c" for i in range(ord("a"), ord("z") + 1)})


def _kinds(s: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    kinds = s.translate(_LETTERS)
    if "y" not in kinds:
        return kinds
    out: list[str] = []
    for k in kinds:
        out.append(k if k != "y" else "v" if out and out[-1] == "c" else "c")
    return "".join(out)


def _measure(s: str) -> int:
    return _kinds(s).count("vc")


def _has_vowel(s: str) -> bool:
    return "v" in _kinds(s)


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _kinds(s)[-1] == "c"


def _cvc(s: str) -> bool:
    return _kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"


def _longest(s: str, rules: dict[int, dict[str, str]]) -> tuple[str, str] | None:
    """The longest of the suffixes, given by length from the longest on, that the word ends with."""
    for n, fits in rules.items():
        if s[-n:] in fits:
            return s[-n:], fits[s[-n:]]
    return None


def _by_length(rules) -> dict[int, dict[str, str]]:
    return {n: {a: b for a, b in rules if len(a) == n} for n in sorted({len(a) for a, _ in rules}, reverse=True)}


_STEPS = tuple(_by_length(r) for r in (STEP2, STEP3, [(x, "") for x in STEP4]))


def stem(word: str) -> str:
    """Lower-cased and stemmed; words of two letters or fewer, or with other characters, are only lower-cased."""
    s = word.lower()
    if len(s) <= 2 or not re.fullmatch("[a-z]+", s):
        return s
    if s.endswith("sses") or s.endswith("ies"):
        s = s[:-2]
    elif s.endswith("s") and not s.endswith("ss"):
        s = s[:-1]
    cut = None
    if s.endswith("eed"):
        if _measure(s[:-3]):
            s = s[:-1]
    elif s.endswith("ed") and _has_vowel(s[:-2]):
        cut = s[:-2]
    elif s.endswith("ing") and _has_vowel(s[:-3]):
        cut = s[:-3]
    if cut is not None:
        s = cut
        if s.endswith(("at", "bl", "iz")):
            s += "e"
        elif _double(s) and s[-1] not in "lsz":
            s = s[:-1]
        elif _measure(s) == 1 and _cvc(s):
            s += "e"
    if s.endswith("y") and _has_vowel(s[:-1]):
        s = s[:-1] + "i"
    for rules in _STEPS[:2]:
        rule = _longest(s, rules)
        if rule and _measure(s[: len(s) - len(rule[0])]):
            s = s[: len(s) - len(rule[0])] + rule[1]
    rule = _longest(s, _STEPS[2])
    if rule:
        left = s[: len(s) - len(rule[0])]
        if _measure(left) > 1 and (rule[0] != "ion" or left.endswith(("s", "t"))):
            s = left
    if s.endswith("e") and (_measure(s[:-1]) > 1 or (_measure(s[:-1]) == 1 and not _cvc(s[:-1]))):
        s = s[:-1]
    if _measure(s) > 1 and s.endswith("ll"):
        s = s[:-1]
    return s


def stem_arrays(words: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda ws: None if ws is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws])

    return F.pandas_udf(run, "array<string>")(words)


def stem_terms(words: Column) -> Column:
    """For a column of distinct terms, to be joined back."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: None if w is None else stem(w))

    return F.pandas_udf(run, "string")(words)
