"""Personal data by anchor expansion.

One Aho-Corasick pass over the ASCII-lower-cased text finds the anchors: at-signs, address
schemes, identifier cues, digits and plus signs.  A deterministic local parser expands each anchor to the boundaries of
an email, an address (url, ip), an account (also a card) or a phone number and validates it.  A parser starts no further left than
where the last one of its kind ended, so each kind reads a character a bounded number of times.

``find_spans`` returns spans as (kind, start, end) in code points, end exclusive.  The base kinds
email, ip, card and phone are exactly the leftmost non-overlapping matches of their patterns that
validate (a failing match is dropped, without a retry).  Anchors add:

* ``url``: the address after ``://`` when it carries a login, after ``mailto:`` or ``tel:``;
* ``account``: after an identifier cue (iban, account, acct, ssn, passport), an IBAN that passes
  its check, a US social-security number, or 6 to 18 letters and digits with at least five digits.

A null text is empty and has no spans; texts are searched whole, in time linear in their length; spans of the
same start are listed by kind, then end.  Rows are independent, so repeated rows have equal results.  ``redact`` replaces ``text``
and ``n_chars`` and keeps all other columns under whatever names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that decides between spans of the same start.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
_ORDER = {kind: n for n, kind in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9]([\x20().0-9-]+)")
_DIGITS = re.compile(r"[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@<>\"':]*:[^\s/?#@<>\"']*@[^\s<>\"']+")
_AFTER_SCHEME = re.compile(r"[A-Za-z0-9._%+@()-]+")
_CUE_GAP = re.compile(r"(?:\s?(?:no|number|nr|id)\b)?[\s.:#=]{0,4}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]{4,16}[A-Za-z0-9](?![A-Za-z0-9-])")

_ANCHORS = {
    "@": "at",
    "://": "scheme",
    "mailto:": "direct",
    "tel:": "direct",
    "iban": "cue",
    "account": "cue",
    "acct": "cue",
    "ssn": "cue",
    "passport": "cue",
    "+": "plus",
    **{digit: "digit" for digit in "0123456789"},
}


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in _ANCHORS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def lower(text: str) -> str:
    """A-Z lower-cased and nothing else, so that places stay the same."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign, reaching back no further than ``after``."""
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account(text: str, end: int) -> tuple[int, int] | None:
    """The identifier that follows a cue ending at ``end``."""
    if end < len(text) and text[end].isalpha():
        return None  # the cue is part of a longer word
    at = _CUE_GAP.match(text, end).end()
    if (m := _IBAN.match(text, at)) and iban_holds(m.group()):
        return m.span()
    if m := _SSN.match(text, at):
        return m.span()
    m = _ACCOUNT.match(text, at)
    return m.span() if m and len(_DIGITS.findall(m.group())) >= 5 else None


def _addresses(text: str, chain: re.Match) -> Iterator[tuple[int, int]]:
    """The ips in numbers joined by dots: each four of them, from the left."""
    at, parts = chain.start(), chain.group().split(".")
    for n in range(0, len(parts) - 3, 4):
        four = parts[n : n + 4]
        end = at + sum(map(len, four)) + 3
        # without their zeros: int() refuses more than 4,300 digits
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in four)):
            yield at, end
        at = end + 1


def _card(found: re.Match) -> bool:
    digits = found.group().replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """The number dialled from the plus sign on: up to its last digit, with one character at least before that."""
    found = _DIALLED.match(text, at)
    if not found:
        return None
    number = found.group().rstrip(" ().-")
    return (at, at + len(number)) if len(number) > 3 and 10 <= len(_DIGITS.findall(number)) <= 15 else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Every span, by start, then kind, then end."""
    found = set()
    after = after_url = after_chain = after_card = 0
    for last, (anchor, size) in _anchors().iter(lower(text)):
        end = last + 1
        if anchor == "digit":
            if last >= after_chain:
                chain = _CHAIN.match(text, last)
                after_chain = chain.end()
                found.update(("ip", *span) for span in _addresses(text, chain))
            if last >= after_card:
                card = _CARD.match(text, last)
                after_card = card.end() if card else end
                if card and _card(card):
                    found.add(("card", *card.span()))
        elif anchor == "at":
            if last >= after and (span := _email(text, last, after)):
                found.add(("email", *span))
                after = span[1]
        elif anchor == "plus":
            if span := _phone(text, last):
                found.add(("phone", *span))
        elif anchor == "scheme":
            if end - size >= after_url and (m := _LOGIN.match(text, end - size)):
                found.add(("url", *m.span()))
                after_url = m.end()
        elif anchor == "direct":
            if m := _AFTER_SCHEME.match(text, end):
                found.add(("url", *m.span()))
        elif span := _account(text, end):
            found.add(("account", *span))
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans(text: Column) -> Column:
    """The spans of each whole text, as an array of (kind, start, end)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(v)]
                for at in range(0, len(batch), 64)
                for v in batch[at : at + 64].to_pylist()
            ]
            yield pa.array(done, _SPAN_TYPE)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SPANS)(F.coalesce(text, F.lit("")))


def redact_text(text: str) -> str:
    """Overlapping spans become one, named after its first kind: ``[EMAIL]``."""
    out, at, merged = [], 0, []
    for kind, start, end in find_spans(text):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """The whole text with its personal data replaced; a null text stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [
                None if v is None else redact_text(v)
                for at in range(0, len(batch), 64)
                for v in batch[at : at + 64].to_pylist()
            ]
            yield pa.array(done, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` redacted and ``n_chars``, where there is one, counted anew; other columns as they are."""
    done = docs.withColumn("text", redacted(F.col("text")))
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
