"""License scans: fuzzy search for short notices.

A text is read as its words (A-Z lower-cased, runs of letters, digits and non-ASCII characters) joined by
single blanks.  A notice occurs where whole words of the text are within ``errors`` edits (characters put in, left
out or changed) of it.

* **Seeds.**  A notice of ``errors`` edits is split into ``errors + 1`` pieces; of any occurrence at least one piece is
  exact (pigeonhole).  One Aho-Corasick pass finds every piece of every notice.
* **Candidates.**  A seed says where its notice would start; the stretches of whole words that start and end within the
  edits of there are its candidates, some few short ones per seed, so time is linear in the text.
* **Verification.**  The regex library's bounded-error matching is asked for each candidate as a whole, with one error, two,
  and so on.  (Its search for a place inside a longer text was not used: a fuzzy group followed by a condition misses places
  whose edits are at their end.)

``find_notices`` returns (label, first word, end word, start, end, errors) of every place, start and end in code points
of the text.  Places of one notice don't overlap; fewer errors go first, then the leftmost.

Null, empty and wordless texts have no words and no places.  Texts are read whole; rows are independent, so ties,
repeated rows and extra columns have no effect, and an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: UTF-8 form of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]+")


class Notice(NamedTuple):
    """Words as they stand in a normalised text, the label they give, and the edits allowed."""

    phrase: str
    label: str
    errors: int = 0


# --- fixed values: the phrases whose exact places are the base ------------------
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# -----------------------------------------------------------------------------

#: Phrases of fewer characters are too close to plain prose for any edit; longer ones get one per so many characters.
_LEAST, _PER_EDIT = 14, 12


def allowed(phrase: str) -> int:
    return len(phrase) // _PER_EDIT if len(phrase) >= _LEAST else 0


#: The base phrases and other short notices, each with the edits its length allows.
NOTICES = tuple(
    Notice(phrase, label, allowed(phrase))
    for phrase, label in (
        *BASE,
        ("gnu lesser general public license", "lgpl"),
        ("gnu affero general public license", "agpl"),
        ("licensed under the apache license version 2 0", "apache-2.0"),
        ("released under the mit license", "mit"),
        ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
        ("redistribution and use in source and binary forms", "bsd"),
        ("bsd 2 clause license", "bsd"),
        ("bsd 3 clause license", "bsd"),
        ("mozilla public license", "mpl"),
        ("eclipse public license", "epl"),
        ("creative commons attribution", "cc-by"),
        ("licensed under cc by nc", "cc-by-nc"),
        ("licensed under cc by sa", "cc-by-sa"),
        ("this is free and unencumbered software released into the public domain", "unlicense"),
        ("all rights reserved", "reserved"),
    )
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece) of the ``errors + 1`` nearly equal pieces of a phrase."""
    n, size = notice.errors + 1, len(notice.phrase)
    if size < n:
        raise ValueError(f"a phrase needs more characters than edits: {notice.phrase!r}")
    cuts = [k * size // n for k in range(n + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Place(NamedTuple):
    notice: int
    start: int
    end: int
    errors: int


class Scanner:
    """Seeds and patterns of a set of notices."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = [Notice(*n) for n in notices]
        self.seeds = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(self.notices):
            for offset, piece in pieces(notice):
                owners.setdefault(piece, []).append((number, offset))
        for piece, of in owners.items():
            self.seeds.add_word(piece, (len(piece), of))
        if owners:
            self.seeds.make_automaton()
        self.patterns = [
            [regex.compile(f"(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={e}}}") for e in range(n.errors + 1)]
            for n in self.notices
        ]

    def places(self, plain: str) -> list[Place]:
        """Every place in a normalised text, which has a blank at either end of each word."""
        if not len(self.seeds):
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, owners) in self.seeds.iter(plain):
            for number, offset in owners:
                starts.setdefault(number, set()).add(last + 1 - size - offset)
        found = []
        for number, at in starts.items():
            found += self._verified(number, sorted(at), plain)
        return sorted(found, key=lambda p: (p.start, p.notice))

    def _verified(self, number: int, starts: list[int], plain: str) -> list[Place]:
        phrase, _, most = self.notices[number]
        patterns, held = self.patterns[number], []
        for start, end in _candidates(starts, len(phrase), most, plain):
            part = plain[start:end]
            if part == phrase:
                held.append((0, start, end))
            elif most and patterns[most].fullmatch(part):
                least = next(e for e in range(1, most + 1) if patterns[e].fullmatch(part))
                held.append((least, start, end))
        taken: list[tuple[int, int]] = []
        done = []
        for errors, start, end in sorted(held):
            at = bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end))
                done.append(Place(number, start, end, errors))
        return done


def _candidates(starts: list[int], size: int, errors: int, plain: str) -> set[tuple[int, int]]:
    """Stretches of whole words, of a length that the errors allow, that start within the errors of one of ``starts``."""
    out = set()
    for near in starts:
        for start in range(max(1, near - errors), near + errors + 1):
            if plain[start - 1 : start] == " ":
                low, high = start + size - errors, start + size + errors + 1
                end = plain.find(" ", low, high)
                while end >= 0:
                    out.add((start, end))
                    end = plain.find(" ", end + 1, high)
    return out


def normalised(text: bytes) -> tuple[int, str]:
    """The number of words, and the words between single blanks, with one at either end."""
    plain = _BETWEEN.sub(b" ", text.lower()).strip(b" ")  # bytes: A-Z only
    return (plain.count(b" ") + 1 if plain else 0), f" {plain.decode('utf-8', 'replace')} "


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    """One per Python worker."""
    return Scanner(notices)


def find_notices(text: bytes, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[dict]]:
    """The number of words of a UTF-8 text, and its places by start, then notice."""
    words, plain = normalised(text)
    places = scanner(notices).places(plain)
    if not places:
        return words, []
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    out, seen, at, first, counted = [], 0, 0, 0, 1
    for place in places:
        # places come by start, so each character is counted about once
        first += plain.count(" ", counted, place.start)
        counted = place.start
        end = first + plain.count(" ", place.start, place.end) + 1
        a, b = spans[first][0], spans[end - 1][1]
        seen, at = seen + len(text[at:a].decode("utf-8", "replace")), a
        notice = notices[place.notice]
        out.append(
            {
                "label": notice.label,
                "phrase": notice.phrase,
                "first_word": first,
                "end_word": end,
                "start": seen,
                "end": seen + len(text[a:b].decode("utf-8", "replace")),
                "errors": place.errors,
                "score": 1 - place.errors / (notice.errors + 1),
            }
        )
    return words, out


PLACES = (
    "struct<n_words:bigint,places:array<struct<label:string,phrase:string,first_word:bigint,end_word:bigint,"
    "start:bigint,end:bigint,errors:int,score:double>>>"
)
_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        (
            "places",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("phrase", pa.string()),
                        ("first_word", pa.int64()),
                        ("end_word", pa.int64()),
                        ("start", pa.int64()),
                        ("end", pa.int64()),
                        ("errors", pa.int32()),
                        ("score", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)


def license_places(text: Column, notices: Sequence[Notice] = NOTICES) -> Column:
    """struct(n_words, places) of each whole text; ``score`` is 1 without errors and falls by each one used."""
    wanted = tuple(Notice(*n) for n in notices)
    if len({n.phrase for n in wanted}) < len(wanted):
        raise ValueError("a phrase stands for one notice")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for at in range(0, len(batch), 64):
                for value in batch[at : at + 64].to_pylist():
                    words, places = find_notices(value, wanted)
                    done.append({"n_words": words, "places": places})
            yield pa.array(done, _TYPE)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, PLACES)(F.coalesce(text.cast("binary"), F.lit(b"")))


def base_places(places: Column) -> Column:
    """The places of the base phrases without an error."""
    exact = [phrase for phrase, _ in BASE]
    return F.filter(places, lambda p: p["phrase"].isin(exact) & (p["errors"] == 0))


def label_list(places: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
