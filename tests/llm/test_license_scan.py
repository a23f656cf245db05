"""Seeded fuzzy search against edit distances of every stretch of words."""

import random
import re

from pyspark.sql import functions as F

from inkproof.llm import license_scan as L
from inkproof.llm.queries import op13_license_scan


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(words):
    return [
        (label, n)
        for phrase, label in L.BASE
        for n in range(len(words))
        if words[n : n + len(phrase.split())] == phrase.split()
    ]


def fewest(words, phrase):
    """The fewest edits between the phrase and any run of whole words, by the table of edit distances."""
    text = " ".join(words)
    row = [0 if i == 0 or text[i - 1] == " " else 10**6 for i in range(len(text) + 1)]
    for i in range(1, len(row)):
        row[i] = min(row[i], row[i - 1] + 1)
    for c in phrase:
        last, row = row, [row[0] + 1] + [0] * len(text)
        for i, t in enumerate(text, 1):
            row[i] = min(last[i - 1] + (c != t), last[i] + 1, row[i - 1] + 1)
    return min([row[i] for i in range(len(text) + 1) if i == len(text) or text[i] == " "], default=10**6)


def damaged(rng, phrase):
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(phrase))
        phrase = rng.choice([phrase[:at] + phrase[at + 1 :], phrase[:at] + "x" + phrase[at:], phrase[:at] + "q" + phrase[at + 1 :]])
    return phrase


def test_places_are_those_within_the_edits():
    rng = random.Random(5)
    filler = ["the", "cc", "by", "gnu", "license", "mit", "public", "Apache", "é", "general", "zz"]
    for _ in range(700):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choices(filler, k=rng.randint(0, 4))
            parts.append(damaged(rng, rng.choice(L.NOTICES).phrase))
        text = rng.choice([" ", "-", ", ", "\n"]).join(parts)
        words = plain_words(text)
        many, places = L.find_notices(text.encode())
        assert many == len(words)
        best = {}
        for p in places:
            best[p["phrase"]] = min(p["errors"], best.get(p["phrase"], 99))
            assert plain_words(text[p["start"] : p["end"]]) == words[p["first_word"] : p["end_word"]]
        want = {n.phrase: e for n in L.NOTICES if (e := fewest(words, n.phrase)) <= n.errors}
        assert best == want, (text, best, want)
        base = [(p["label"], p["first_word"]) for p in places if not p["errors"] and p["phrase"] in dict(L.BASE)]
        assert sorted(base) == sorted(plain_base(words))


def test_places_of_a_notice_do_not_overlap_and_long_texts_are_linear():
    text = "gnu general public licence, gnu generl public license " * 4000
    _, places = L.find_notices(text.encode())
    for phrase in {p["phrase"] for p in places}:
        spans = [(p["start"], p["end"]) for p in places if p["phrase"] == phrase]
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert sum(p["phrase"] == "gnu general public license" for p in places) == 8000
    _, places = L.find_notices(b"gnu general " * 50000 + b"mit" + b" " * 10**6 + b"License")
    assert [p["label"] for p in places] == ["mit"]


ROWS = [
    (1, "Released under the MIT License.", "x"),
    (2, "This work is licensed under the GNU General Public Licence, version 3.", "x"),
    (3, None, "x"),
    (4, "", None),
    (5, "--- !!", "x"),
    (1, "Released under the MIT License.", "x"),
    (6, "CC-BY cc by, cc by", "x"),
    (None, "apache\tlicense", "x"),
]


def test_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((tuple(r[:8]) for r in op13_license_scan(spark, str(tmp_path)).collect()), key=str)
    one = (1, 5, 1, 3, 4 - 1, "mit", "mit", 1.0)
    assert rows == sorted(
        [
            one,
            one,
            (2, 12, 0, None, None, "", "gpl", 1 - 1 / 3),
            (3, 0, 0, None, None, "", "", 0.0),
            (4, 0, 0, None, None, "", "", 0.0),
            (5, 0, 0, None, None, "", "", 0.0),
            (6, 6, 3, 0, 4, "cc-by", "cc-by", 1.0),
            (None, 2, 1, 0, 0, "apache", "apache", 1.0),
        ],
        key=str,
    )
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(L.license_places(F.col("text"))).count() == 0


def test_query_on_whole_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op13_license_scan(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words, r = plain_words(d.text), got[d.doc_id]
        base = plain_base(words)
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((min(n for _, n in base), max(n for _, n in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for label, _ in base}))
        if len(words) < 80:
            near = {n: e for n in L.NOTICES if (e := fewest(words, n.phrase)) <= n.errors}
            assert r.labels == ",".join(sorted({n.label for n in near}))
            assert r.score == max((1 - e / (n.errors + 1) for n, e in near.items()), default=0.0)


def test_errors():
    for bad in ([("ab", "x", 2)], [("abc", "x", 0), ("abc", "y", 1)]):
        try:
            L.Scanner([L.Notice(*n) for n in bad])
            L.license_places(F.lit("x"), bad)
        except ValueError:
            continue
        raise AssertionError(bad)
