"""Suffix automaton against windows compared one by one."""

import random

from inkproof.llm import decontaminate as D


def brute(document, items, window):
    hit, ids = set(), set()
    for key, item in items.items():
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(document) - size + 1) if size else ():
            if tuple(document[i : i + size]) in grams:
                ids.add(key)
                hit.update(range(i, i + size))
    return hit, ids


def test_automaton_on_random_words():
    rng = random.Random(2)
    for _ in range(600):
        window = rng.randint(1, 5)
        vocabulary = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        items = {n: rng.choices(vocabulary, k=rng.randint(0, 12)) for n in range(rng.randint(0, 5))}
        document = rng.choices([*vocabulary, b"z"], k=rng.randint(0, 40))
        spans, ids = D.matches(D.build(items, window), document)
        hit, want = brute(document, items, window)
        assert {i for a, b in spans for i in range(a, b)} == hit
        assert ids == want
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


ROWS = [
    (1, "x0 One two, THREE four! é five x1"),
    (2, "nothing here"),
    (3, None),
    (4, ""),
    (5, "short item"),
    (1, "x0 One two, THREE four! é five x1"),
]
ITEMS = [(10, "one two three four"), (11, "three four é five"), (12, "short item"), (13, None), (None, "nothing here"), (10, "one two three four"), (14, "--")]


def _frames(spark):
    docs = spark.createDataFrame([(a, b, "k") for a, b in ROWS], "doc_id long, text string, overlap string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_spans_and_blocks(spark):
    docs, items = _frames(spark)
    one = {(r.doc_id, str(r.overlap)) for r in D.with_overlap(docs, items, window=3).collect()}
    many = {(r.doc_id, str(r.overlap)) for r in D.with_overlap(docs, items, window=3, block_words=2).collect()}
    assert one == many
    rows = {r.doc_id: r.overlap for r in D.with_overlap(docs, items, window=3).collect()}
    assert rows[1].item_ids == [10, 11] and rows[1].n_words == 8 and rows[1].n_hit == 6
    assert [ROWS[0][1][s.start : s.end] for s in rows[1].spans] == ["One two, THREE four! é five"]
    assert rows[5].item_ids == [12] and rows[3].n_words == 0 and rows[2].n_hit == 0


def test_cut(spark):
    docs, items = _frames(spark)
    kept = D.decontaminate(docs.drop("overlap"), items, window=3, max_coverage=0.8).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "x0  x1"), (1, "x0  x1"), (2, "nothing here"), (3, ""), (4, "")]
    empty = D.decontaminate(docs.drop("overlap"), items.limit(0), window=3)
    assert empty.count() == len(ROWS)
    assert D.decontaminate(docs.limit(0), items, window=3).count() == 0


def test_an_item_id_with_most_texts_is_dealt_over_the_blocks(spark):
    rows = [(1, f"w{n} w{n + 1} w{n + 2} w{n + 3}") for n in range(400)] + [(2, "w5 w6 w7 x")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    files = D.automata(items, 3, 100)
    sizes = [sum(len(v) > 0 for v in a.items.values()) for a in map(D._loaded, files) if a]
    assert len(sizes) > 5 and max(sizes) < 200
    docs = spark.createDataFrame([(n, f"a w{n} w{n + 1} w{n + 2} w{n + 3} b", "x") for n in range(40)], "doc_id long, text string, found string")
    one = {(r.doc_id, str(r.overlap)) for r in D.with_overlap(docs, items, window=3).collect()}
    many = {(r.doc_id, str(r.overlap)) for r in D.with_overlap(docs, items, window=3, block_words=100).collect()}
    assert one == many and all("n_hit=4" in text for _, text in one)


def test_very_long_text(spark):
    text = "filler words here " * 200_000 + "one two three four"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = D.with_overlap(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), window=3).collect()
    assert (row.overlap.n_words, row.overlap.n_hit, row.overlap.item_ids) == (600_004, 4, [10])
