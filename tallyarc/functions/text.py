"""Words, stems and token rules of the lexical search. Stemming is the published algorithm of Porter (1980)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that searches leave out of a query.
STOP_WORDS = (
    "a an and any are about as at be by do does did for from have has i if in is it its last like me my of on one or our out over so some "
    "that the their them then there these they this to too up us was we week were what when where which while who why will with would "
    "you your how anything stuff thing things"
).split()
#: Words that the title comparison of near duplicates leaves out.
DEDUP_STOP = (
    "the and for not with from that this these those are was were been have has had but all can any will into when then than there about "
    "over under between before after through also only just lore entry quest project agent agents"
).split()


def query_tokens(query: str) -> list[str]:
    """Lower-case words of a query without stop words (all of them if nothing else is there), of two characters or more."""
    words = re.findall(r"[A-Za-z0-9_]+", query.lower())
    kept = [w for w in words if w not in STOP_WORDS] or words
    return [w for w in kept if len(w) >= 2]


def dedup_tokens(title: str) -> list[str]:
    """The first five longer words of a title, or none when there are fewer than three."""
    words = [w for w in re.findall(r"[A-Za-z0-9_]+", title.lower()) if len(w) >= 4 and w not in DEDUP_STOP]
    return words[:5] if len(words) >= 3 else []


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def words(text: Column) -> Column:
    """ASCII words of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))


def distinct_words(text: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= least))


def query_text(text: Column) -> Column:
    """A search over prefixes of any of a text's words, without stop words (all of them if nothing else is there)."""
    every = words(text)
    kept = F.filter(every, lambda w: ~w.isin(*STOP_WORDS))
    used = F.filter(F.when(F.size(kept) > 0, kept).otherwise(every), lambda w: F.length(w) >= 2)
    return F.array_join(F.transform(used, lambda w: F.concat(w, F.lit("*"))), " OR ")


def dedup_query_text(title: Column) -> Column:
    """A search over prefixes of all of the first five longer words of a title; empty when there are fewer than three."""
    used = F.filter(words(title), lambda w: (F.length(w) >= 4) & ~w.isin(*DEDUP_STOP))
    return F.when(F.size(used) >= 3, F.array_join(F.transform(F.slice(used, 1, 5), lambda w: F.concat(w, F.lit("*"))), " AND ")).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters. A lookahead finds them in one pass: taking each by its position would scan the text anew
    for each, as characters differ in bytes."""
    one = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.array_distinct(F.regexp_extract_all(one, F.lit("(?s)(?=(...))"), F.lit(1)))


class Porter:
    """Stems of English words in lower case."""

    def __init__(self):
        self.seen: dict[str, str] = {}

    @staticmethod
    def _shape(word: str) -> str:
        """A letter for each: v for vowels, c for consonants; y is a vowel after a consonant."""
        out = ""
        for i, c in enumerate(word):
            out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
        return out

    def _measure(self, stem: str) -> int:
        return len(re.findall("v+c+", self._shape(stem)))

    def _vowel(self, stem: str) -> bool:
        return "v" in self._shape(stem)

    def _double(self, word: str) -> bool:
        return len(word) > 1 and word[-1] == word[-2] and self._shape(word)[-1] == "c"

    def _short(self, word: str) -> bool:
        return self._shape(word)[-3:] == "cvc" and word[-1] not in "wxy"

    #: Suffixes with what takes their place when the stem's measure is over 0.
    STEP2 = "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
    STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
    #: Suffixes that go when the stem's measure is over 1.
    STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

    def _table(self, word: str, table: str) -> str:
        for suffix, to in sorted((x.split(" ") for x in table.split("|")), key=lambda p: -len(p[0])):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                return stem + to if self._measure(stem) > 0 else word
        return word

    def stem(self, word: str) -> str:
        if word in self.seen:
            return self.seen[word]
        out = self._stem(word) if len(word) > 2 else word
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[word] = out
        return out

    def _stem(self, w: str) -> str:
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self._measure(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and self._vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self._measure(w) == 1 and self._short(w):
                        w += "e"
                    break
        if w.endswith("y") and self._vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self._table(self._table(w, self.STEP2), self.STEP3)
        for suffix in sorted(self.STEP4.split(), key=lambda s: -len(s)):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if self._measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or m == 1 and not self._short(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and self._measure(w) > 1:
            w = w[:-1]
        return w


_porter = Porter()


@F.pandas_udf(StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    """Stems of folded terms; call it on distinct terms and join back."""
    return terms.map(lambda t: _porter.stem(fold(t)))
