"""Plain Python meaning of the matching rules, for brute-force comparison."""

from __future__ import annotations

import re
from difflib import SequenceMatcher


def plain_normal(text):
    if text is None:
        return ""
    steps = [(r"\^?\{\}?\[?\]?", ""), (r"\s+", " "), ("[$€£¥]", ""), (r",(\d{3})", r"\1")]
    result = text.lower().strip()
    for pattern, by in steps:
        result = re.sub(pattern, by, result)
    return result


def plain_find(value, text, threshold):
    """(found, confidence) of a value in a text, comparing every pair of words."""
    wanted, source = plain_normal(value), plain_normal(text)
    if not value or wanted in source or not wanted.split():
        return True, 1.0
    seen = set(source.split())
    best = [
        max((SequenceMatcher(None, w, s).ratio() for s in seen), default=0.0)
        for w in wanted.split()
    ]
    hits = [b for b in best if b >= threshold]
    return len(hits) == len(best), (sum(hits) / len(best) if hits else 0.0)
