"""Search by intervals against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from inkproof.llm import ranked_search as R


def plain_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def plain_search(docs, queries, k):
    counted = [(key, Counter(plain_terms(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    many, total = sum(n > 0 for n in sizes), max(sum(sizes), 1)
    held = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in {q for q in queries if q[0] is not None}:
        asked.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for (key, c), n in zip(counted, sizes):
            m = 75 + (25 * n * many) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * many + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in terms.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_intervals_on_random_lists():
    rng = random.Random(3)
    for whole in (0, 8, R._WHOLE):
        R._WHOLE, kept = whole, R._WHOLE
        for _ in range(150):
            size, lists = rng.randint(1, 60), rng.randint(1, 8)
            postings = {(t, d): rng.randint(0, 5) for t in range(lists) for d in range(size) if rng.random() < 0.5}
            if not postings:
                continue
            numbers, documents = (np.array(c) for c in zip(*postings))
            order = np.array(rng.sample(range(len(postings)), len(postings)))
            impacts = np.array(list(postings.values()))
            shard = R.Shard(numbers[order] * 3, documents[order], impacts[order], size)
            asked = rng.sample(range(lists + 2), rng.randint(1, lists + 2))
            times, k = [rng.randint(1, 3) for _ in asked], rng.randint(1, 10)
            got = shard.best(np.array(asked) * 3, np.array(times), k)
            scores = [(sum(m * postings.get((t, d), 0) for t, m in zip(asked, times)), -d) for d in range(size)]
            assert sorted(got) == sorted(sorted(s for s in scores if s[0] > 0)[-k:])
        R._WHOLE = kept


def rows(frame):
    return sorted(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


DOCS = [
    (1, "The cat, the dog! Été 42", "x"),
    (2, "cat cat cat", "x"),
    (3, None, "x"),
    (4, "", "x"),
    (5, "-- ??", None),
    (2, "cat cat cat", "x"),
    (None, "dog été", "x"),
    (7, "bird", "x"),
    (6, "bird", "x"),
]
QUERIES = [(10, "cat dog cat"), (10, "cat dog cat"), (10, "bird"), (11, None), (12, "--"), (None, "cat"), (13, "nowhere"), (14, "ÉTÉ été"), (15, "the bird")]


def test_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, score string")
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    want = plain_search([d[:2] for d in DOCS], QUERIES, 3)
    assert rows(R.search(docs, queries, 3)) == want
    # many shards, many blocks, and a bit table that keeps nearly everything
    assert rows(R.search(docs, queries, 3, shard_postings=2, block_terms=2, slots=2)) == want
    assert R.search(docs.limit(0), queries).count() == R.search(docs, queries.limit(0)).count() == 0
    assert R.search(docs, queries).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_very_long_text_and_ties(spark):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(300)]
    docs = [(n, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for n in range(300)] + [(900, " ".join(words * 2000))]
    docs += [(1000 + n, "w1 w2") for n in range(100)]  # more ties than places
    queries = [(n, " ".join(rng.choices(words, k=12))) for n in range(8)] + [(8, "w1 w2")]
    got = rows(R.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), shard_postings=700))
    assert got == plain_search(docs, queries, 20)
    tied = [r[2] for r in got if r[0] == 8 and r[2] >= 1000]
    assert len(tied) > 10 and tied == list(range(1000, 1000 + len(tied)))
