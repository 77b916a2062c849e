"""English stems, and terms without accents, as columns: the suffix rules of the Porter2 algorithm by its published description."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# Words with stems of their own, words left alone (at first, and after the plural step), suffixes and what they become.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

VOWEL, DOUBLE, SHORT = re.compile("[aeiouy]"), re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), re.compile(r"(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
REGION = re.compile("[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where what follows the first vowel and consonant begins, and where that does again within."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), 0)
    if not first:
        found = REGION.search(word)
        first = found.end() if found else len(word)
    second = REGION.search(word, first)
    return first, second.end() if second else len(word)


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), None)


def stem(word: str) -> str:
    """The stem of an English word in lower case; words of other letters come back as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in OWN:
        return OWN[word]
    # A y that begins the word or follows a vowel is no vowel: Y.
    word = re.sub("(?<=[aeiouy])y", "Y", re.sub("^y", "Y", word))
    r1, r2 = _regions(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in WHOLE:
        return word

    end = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif DOUBLE.search(word):
            word = word[:-1]
        elif len(word) <= r1 and SHORT.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _longest(word, SECOND)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3] in "cdeghkmnrt"):
        word = word[: -len(end)] + SECOND[end]
    end = _longest(word, THIRD)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + THIRD[end]
    end = _longest(word, FOURTH)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not SHORT.search(word[:-1])) or word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


@lru_cache(100_000)
def english(term: str) -> str:
    """A term without accents, stemmed."""
    if not term.isascii():
        term = "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))
    return stem(term)


@arrow_udf(ArrayType(StringType()))
def english_terms(lists: pa.Array) -> pa.Array:
    """Lists of terms through english(); each distinct term of a batch is looked at once."""
    lists = lists.cast(pa.list_(pa.string()))
    flat = lists.flatten().dictionary_encode()
    made = pa.array([None if t is None else english(t) for t in flat.dictionary.to_pylist()], pa.string())
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(offsets, made.take(flat.indices), mask=lists.is_null())
