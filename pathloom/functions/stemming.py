"""Porter's suffix stripping (1980) over arrays of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffixes of the published algorithm's steps 2 to 4, with what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c for each run of consonants and v for each run of vowels; y is a vowel after a consonant."""
    kinds = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and kinds[-1:] == "c")
        kinds += "v" if vowel else "c"
    return re.sub(r"(.)\1+", r"\1", kinds)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    return len(stem) > 2 and _shape(stem[-3:]) == "cvc" and stem[-1] not in "wxy" and not _shape(stem[:-2])[-1:] == "v"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a word in lower case; words of up to two letters stay."""
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    seen: dict[str, str] = {}
    for tokens in batches:
        out = []
        for row in tokens:
            for t in row:
                if t not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen[t] = stem(t) if len(t) > 3 else t
            out.append([seen.get(t) or (stem(t) if len(t) > 3 else t) for t in row])
        yield pd.Series(out)


def porter(tokens: Column) -> Column:
    """The tokens with those of more than three letters stemmed."""
    return _stems(tokens)
