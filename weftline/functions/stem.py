"""The published English stemmer of the Snowball family (Porter's second), word by word in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The algorithm's word and suffix tables.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# English stop words that searches leave out.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    first = re.match("gener|commun|arsen", w) or _REGION.search(w)
    r1 = first.end() if first else len(w)
    second = _REGION.search(w, r1)
    r2 = second.end() if second else len(w)
    has_vowel = lambda s: re.search("[aeiouy]", s) is not None

    w = w[: len(w) - len(_longest(w, ("'", "'s", "'s'")))]
    end = _longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[: -2 if len(w) > 4 else -1]
    elif end == "s" and has_vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURALS:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + "ee"
    elif end and has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[-len(end) - 1 : -len(end)]
        if (end != "ogi" or before == "l") and (end != "li" or before in tuple("cdeghkmnrt")):
            w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stemmed(text: pd.Series) -> pd.Series:
    """The stems of a text's words ([a-z0-9_']+ of two signs or more in lower case) without stop words, in order."""
    word = re.compile(r"[a-z0-9_][a-z0-9_']+")
    return pd.Series([" ".join(stem(w) for w in word.findall((t or "").lower()) if w not in STOP_WORDS) for t in text], dtype=object)
