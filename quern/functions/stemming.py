"""Tokens of the full-text index: no diacritics, lower case, English stems by Porter's rules of 1980."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+")
# Endings of the published steps 2, 3 and 4.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_STEP2 = sorted(zip(STEP2[::2], STEP2[1::2], strict=True), key=lambda p: -len(p[0]))
_STEP4 = sorted(STEP4, key=lambda s: -len(s))


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for end, into in _STEP2:
        if w.endswith(end):
            w = w[: -len(end)] + into if _measure(w[: -len(end)]) > 0 else w
            break
    for end, into in STEP3.items():
        if w.endswith(end):
            w = w[: -len(end)] + into if _measure(w[: -len(end)]) > 0 else w
            break
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def plain(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@lru_cache(1 << 17)
def word_stems(word: str) -> tuple[str, ...]:
    return tuple(porter(w) for w in TOKEN.findall(plain(word)))


def stems(text: Column) -> Column:
    """Stems of all words in order (array of strings); Arrow batches, each distinct word stemmed once a batch."""

    def all_stems(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(t: str | None) -> list[str]:
            out = []
            for w in TOKEN.findall(plain(t or "")):
                if w not in known:
                    known[w] = porter(w)
                out.append(known[w])
            return out

        return texts.map(one)

    return F.pandas_udf(all_stems, "array<string>")(text)
