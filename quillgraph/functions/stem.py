"""Unicode folding and Porter stems of a vocabulary.

Texts hold few distinct words, so words are folded and stemmed once each and joined back."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of Porter's algorithm (1980): a measure of vowel-consonant runs and suffix tables.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def fold(word: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The Porter stem of a lower-case word; words of other alphabets stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    for suffix in sorted(STEP4 + ["ion"], key=len, reverse=True):
        if word.endswith(suffix):
            body = word[: -len(suffix)]
            if _measure(body) > 1 and (suffix != "ion" or body.endswith(("s", "t"))):
                word = body
            break
    if word.endswith("e"):
        body = word[:-1]
        if _measure(body) > 1 or (_measure(body) == 1 and not _short(body)):
            word = body
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("term").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array([stem(fold(w)) for w in words], pa.string())], names=["term", "stem"])


def stems(docs: DataFrame, text: str = "body") -> DataFrame:
    """(id, stem, tf) for each document: its tokens by stem."""
    tf = docs.select("id", F.explode(T.tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    table = tf.select("term").distinct().mapInArrow(_stems, "term string, stem string")
    return tf.join(table, "term").groupBy("id", "stem").agg(F.sum("tf").alias("tf"))
