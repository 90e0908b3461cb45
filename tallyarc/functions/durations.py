"""Durations as people write them."""

from __future__ import annotations

import re

DAYS = {"d": 1, "w": 7, "m": 30}


def days(text: str) -> int:
    """Days of ``Nd``, ``Nw`` or ``Nm`` (months of 30)."""
    found = re.fullmatch(r"([0-9]+)([dwm])", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * DAYS[found[2]]


def window_days(text: str) -> int:
    """The same in either case; a bare number counts days, nothing 30."""
    text = text.strip().lower()
    if not text:
        return 30
    return int(text) if text.isdigit() else days(text)
