"""Word pieces: lower case, punctuation and CJK characters apart, greedy longest match with ``##`` inside a word."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LONGEST_WORD, UNKNOWN = 100, "[UNK]"


def _cjk(c: str) -> bool:
    o = ord(c)
    return 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0x20000 <= o <= 0x2FA1F or 0xF900 <= o <= 0xFAFF


def _punctuation(c: str) -> bool:
    return unicodedata.category(c).startswith("P") or c.isascii() and c.isprintable() and not c.isalnum() and c != " "


@lru_cache(65_536)
def _spaced(c: str) -> str:
    if c.isspace():
        return " "
    if c == "\ufffd" or unicodedata.category(c).startswith("C"):
        return ""
    return f" {c} " if _cjk(c) or _punctuation(c) else c


def basic_words(text: str) -> list[str]:
    return "".join(map(_spaced, text.lower())).split()


def _word(word: str, vocab: set[str]) -> list[str]:
    own: list[str] = []
    at = 0
    while at < len(word) <= LONGEST_WORD:
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        if end is None:
            break
        own.append(("##" if at else "") + word[at:end])
        at = end
    return own if at >= len(word) else [UNKNOWN]


def pieces(text: str, vocab: set[str]) -> list[str]:
    words = basic_words(text)
    each = {w: _word(w, vocab) for w in set(words)}
    return [x for w in words for x in each[w]]


def pieces_udf(vocab: list[str]):
    known = set(vocab)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t or "", known))

    return F.pandas_udf(run, ArrayType(StringType()))
