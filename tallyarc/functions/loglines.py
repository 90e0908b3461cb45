"""Rules of single log lines as column expressions; ``compact`` has the same rules for whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyarc.functions.compact import LEVEL_SCORE, LEVELS, SUMMARY_COUNTS, SUMMARY_RULE, SUMMARY_STARTS, TRACE


def _bytes(rule: str) -> str:
    """A rule of ``compact`` as SQL engines read it: ASCII classes and word bounds, a dot for all but a line feed, an end that is the text's end."""
    plain = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\s": r"[\t\n\f\r ]", r"\w": _WORD, r"\d": "[0-9]", "$": r"\z"}
    return re.sub(r"\\.|\$|\.", lambda m: plain.get(m[0], "[^\n]" if m[0] == "." else m[0]), rule)


_WORD = "[0-9A-Za-z_]"


def _first(line: Column) -> Column:
    """The first word of a level in the line, or an empty text: one search for all of them."""
    words = "|".join(w for _, names in LEVELS for w in names)
    return F.regexp_extract(F.lower(line), f"(?<!{_WORD})({words})(?!{_WORD})", 1)


def _of(values: dict[str, object]) -> Column:
    """What ``values`` have for the level of each word, as a map."""
    return F.create_map(*(F.lit(x) for name, names in LEVELS if name in values for w in names for x in (w, values[name])))


def level(line: Column) -> Column:
    """The level whose word comes first in the line, or unknown."""
    return F.coalesce(F.try_element_at(_of({name: name for name, _ in LEVELS}), _first(line)), F.when(line.isNotNull(), "unknown"))


def is_trace(line: Column) -> Column:
    return line.rlike(_bytes(TRACE))


def is_summary(line: Column) -> Column:
    low = F.lower(line)
    starts = low.rlike(f"^({'|'.join(SUMMARY_STARTS)})")
    return line.rlike(_bytes(SUMMARY_RULE)) | low.rlike(_bytes(SUMMARY_COUNTS)) | starts


def score(line: Column) -> Column:
    """What the line's level says, more for traces and summaries, one at most."""
    own = F.coalesce(F.try_element_at(_of(LEVEL_SCORE), _first(line)), F.lit(0.1))
    return F.least(F.lit(1.0), own + F.when(is_trace(line), 0.3).otherwise(0.0) + F.when(is_summary(line), 0.4).otherwise(0.0))


def dedupe_key(line: Column) -> Column:
    """Runs of digits after the first colon or equals sign as one mark."""
    cut = F.regexp_instr(line, F.lit("[:=]"))
    marked = F.concat(F.substring(line, F.lit(1), cut - 1), F.regexp_replace(F.substring(line, cut, F.length(line)), "[0-9]+", "#"))
    return F.when(cut > 0, marked).otherwise(line)
