"""The published Snowball stemmer for Russian, as a pandas function for Cyrillic terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "аеиоуыэюя"
#: Endings of the published algorithm (fixed values).
_GERUND1 = ("вшись", "вши", "в")
_GERUND2 = ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
_ADJECTIVE = "ими ыми его ого ему ому их ых ее ие ые ое ей ий ый ой ем им ым ом ую юю ая яя ою ею".split()
_PARTICIPLE1 = ("ющ", "вш", "ем", "нн", "щ")
_PARTICIPLE2 = ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB1 = "йте ешь нно ете ла на ли ем ло но ет ют ны ть й л н".split()
_VERB2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split()
_NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()
_SUPERLATIVE = ("ейше", "ейш")
_DERIVATIONAL = ("ость", "ост")


def _longest(word: str, rv: int, plain: list[str] | tuple[str, ...], after: list[str] | tuple[str, ...] = ()) -> int | None:
    """Where the longest ending begins in the region; those of ``after`` need а or я before."""
    best: tuple[int, int] | None = None
    for ends, led in ((plain, False), (after, True)):
        for e in ends:
            at = len(word) - len(e)
            if at < rv or not word.endswith(e) or best and len(e) <= best[0]:
                continue
            if led and not (at - 1 >= rv and word[at - 1] in "ая"):
                continue
            best = (len(e), at)
    return best[1] if best else None


def stem_russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(f"[{_VOWELS}]", word)
    if not m:
        return word
    rv = m.end()
    r = re.search(f"[{_VOWELS}][^{_VOWELS}]", word)
    r1 = r.end() if r else len(word)
    r = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, r1)
    r2 = r.end() if r else len(word)
    at = _longest(word, rv, _GERUND2, _GERUND1)
    if at is not None:
        word = word[:at]
    else:
        at = _longest(word, rv, _REFLEXIVE)
        word = word[:at] if at is not None else word
        at = _longest(word, rv, _ADJECTIVE)
        if at is not None:
            word = word[:at]
            at = _longest(word, rv, _PARTICIPLE2, _PARTICIPLE1)
            word = word[:at] if at is not None else word
        else:
            at = _longest(word, rv, _VERB2, _VERB1)
            if at is None:
                at = _longest(word, rv, _NOUN)
            word = word[:at] if at is not None else word
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    at = _longest(word, max(rv, r2), _DERIVATIONAL)
    word = word[:at] if at is not None else word
    if word.endswith("нн") and len(word) - 2 >= rv - 1:
        return word[:-1]
    at = _longest(word, rv, _SUPERLATIVE)
    if at is not None:
        word = word[:at]
        return word[:-1] if word.endswith("нн") else word
    return word[:-1] if word.endswith("ь") and len(word) - 1 >= rv else word


def _stem_lists(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if not re.search("[\u0400-\u04ff]", t):
            return t
        if t not in known:
            known[t] = stem_russian(t)
        return known[t]

    return lists.map(lambda ts: None if ts is None else [one(t) for t in ts])


def stemmed(terms: Column) -> Column:
    """The terms with Cyrillic ones stemmed; any string-to-string function may stand in its place."""
    return F.pandas_udf(_stem_lists, T.ArrayType(T.StringType()))(terms)
