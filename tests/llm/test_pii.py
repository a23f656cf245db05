"""Personal data against the plain patterns."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from inkproof.llm import pii
from inkproof.llm.queries import op5_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = sum(digits[-1::-2])
    return (total + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def plain(text):
    digits = lambda m: [int(c) for c in m.group() if c in "0123456789"]
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


def test_base_spans_on_random_text():
    rng = random.Random(3)
    pieces = ["@", "@", ".", "-", "a", "b.c", "%", "+", "1", "25", "0", "255", " ", "(", ")", "é", "İ", "x@y.z", "+1", "4111 1111 1111 1111", "mailto:", "://", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert base(text) == plain(text), text


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op5_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    found = 0
    for row in rows:
        spans = plain(texts[row.doc_id])
        found += len(spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))
    assert found


def test_anchors_expand_and_validate():
    text = "see https://bob:secret@host.example/x?y and http://host.example, IBAN: GB82 WEST 1234 5698 7654 32."
    text += " iban GB82 WEST 1234 5698 7654 33; account no: 00123456, accountant 123456, ssn 123-45-6789"
    got = [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k not in pii.BASE_KINDS]
    assert got == [
        ("url", "://bob:secret@host.example/x?y"),
        ("account", "GB82 WEST 1234 5698 7654 32"),
        ("account", "00123456"),
        ("account", "123-45-6789"),
    ]


def test_long_texts_are_linear():
    assert pii.find_spans("a" * 2_000_000 + "@") == []
    assert pii.find_spans("+1" + "-" * 1_000_000) == []
    assert pii.find_spans("1." * 300_000) == base("1." * 300_000)


def test_redaction(spark):
    rows = [(1, "é write a@b.example now", "en", "s", 0), (2, None, None, None, None), (3, "", "", "", 0), (1, "clean", "en", "s", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text, r.n_chars) for r in pii.redact(frame).collect()}
    assert got == {(1, "é write [EMAIL] now", 19), (2, None, None), (3, "", 0), (1, "clean", 5)}
    assert pii.redact(frame).columns == frame.columns
    assert frame.limit(0).select(pii.spans(F.col("text"))).collect() == []


def test_ip_parts_of_many_zeros(spark):
    zeros = "0" * 5000
    texts = [f"at 1.1.1.{zeros} x", f"1.{zeros}255.3.4", f"1.{zeros}256.3.4", "0.00.000.0"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found if s.kind == "ip"] for r in rows.select("doc_id", pii.spans(F.col("text")).alias("found")).collect()}
    assert got == {0: [("ip", 3, 5009)], 1: [("ip", 0, 5009)], 2: [], 3: [("ip", 0, 10)]}


def test_every_parser_is_linear():
    grows = ["://a:", "a:", "://a:b@", "1.", "1 ", "1-", "+1", "+1(", "0", "@a", "a@", "a.", "iban ", "account:", "tel:", "mailto:a@", "ssn 1-", "GB82", "x" * 20, "://", "1.1.1.1.", "+"]
    for start in ("", "://", "iban ", "+1", "a@", "mailto:", "1.1.1."):
        for piece in grows:
            text = start + piece * (300_000 // len(piece))
            began = time.perf_counter()
            pii.find_spans(text)
            assert time.perf_counter() - began < 4, (start, piece)
