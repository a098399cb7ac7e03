"""Tokens of the keyword index, as expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _accents() -> tuple[str, str]:
    """Letters with marks and the letters below them, by canonical decomposition; marks of their own are dropped."""
    pairs, marks = {}, []
    for code in range(0xA0, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(m) for m in base[1:]):
            pairs[c] = base[0]
        elif 0x300 <= code <= 0x36F:
            marks.append(c)
    return "".join(pairs) + "".join(marks), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Lower-cased, without marks on letters. Texts of ASCII alone are spared the look at each letter."""
    low = F.lower(text)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(low, *_accents())).otherwise(low)


def word_tokens(text: Column) -> Column:
    """Runs of letters, numbers and private-use characters of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit("([\\p{L}\\p{N}\\p{Co}]+)"), 1)


def trigrams(text: Column) -> Column:
    """All runs of three characters of the lower-cased text."""
    characters = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    after = lambda n: F.slice(characters, n + 1, F.greatest(F.size(characters) - n, F.lit(0)))
    pairs = F.zip_with(characters, after(1), lambda a, b: F.concat(a, b))  # null where there is no next one
    return F.filter(F.zip_with(pairs, after(2), lambda ab, c: F.concat(ab, c)), lambda t: t.isNotNull())


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Each token's stem; a stem is worked out once for each distinct token of a batch."""
    known = {t: stem(t) for t in {t for row in tokens if row is not None for t in row}}
    return tokens.map(lambda row: None if row is None else [known[t] for t in row])


def index_tokens(text: Column, tokenizer: str = "unicode61") -> Column:
    text = F.coalesce(text, F.lit(""))
    if tokenizer == "trigram":
        return trigrams(text)
    return stemmed(word_tokens(text)) if tokenizer == "porter" else word_tokens(text)


def query_phrases(query: Column, tokenizer: str = "unicode61") -> Column:
    """array<array<string>>: each word of the query as the run of tokens that must stand together."""
    query = F.coalesce(query, F.lit(""))
    if tokenizer == "trigram":
        words = F.split(F.translate(query, "\0", " "), "\\s+")
        found = F.transform(words, trigrams)
    else:
        words = F.regexp_extract_all(query, F.lit("([\\p{L}\\p{N}\\p{M}_]+)"), 1)
        found = F.transform(words, word_tokens)
    return F.filter(found, lambda p: F.size(p) > 0)


def keyword_text(text: Column, keywords: Column, override: Column) -> Column:
    """What the index reads of an item: the override, else keywords and a line break before the text."""
    return F.coalesce(override, F.when(keywords.isNull(), text).otherwise(F.concat(keywords, F.lit("\n"), text)))


def _measure(word: str) -> int:
    """Changes from vowels to consonants in the word."""
    kinds = [_vowel(word, i) for i in range(len(word))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, and not in w, x or y."""
    n = len(word)
    return n >= 3 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


#: Fixed values of the published algorithm (Porter 1980): endings and what replaces them, where what is before has a measure above 0.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Endings that go where what is before has a measure above 1.
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            return base + table[end] if _measure(base) > 0 else word
    return word


def stem(word: str) -> str:
    """Porter's stem of a lower-case ASCII word of 3 to 64 letters; other words stay."""
    if not 3 <= len(word) <= 64 or not (word.isascii() and word.isalpha()):
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            base = word[: len(word) - len(end)]
            if word.endswith(end) and any(_vowel(base, i) for i in range(len(base))):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and not _vowel(base, len(base) - 1) and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _short(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and any(_vowel(word, i) for i in range(len(word) - 1)):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
