"""Near-duplicates and components against plain sets."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from inkproof.llm import minhash
from inkproof.llm.graph import components
from inkproof.llm.shared import cut


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)]
    links += [(1000, n) for n in range(1001, 1200)] + [(7, 7)]
    nodes = {n for pair in links for n in pair}
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(nodes, links)
    assert got == {n: want[n] for n in nodes if any(n in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_limits():
    for m, k in minhash.fewest_matches(200, 40, 0.75, 1e-6):
        # a pair at the threshold has so few matches with about the chosen probability at most
        rng = np.random.default_rng(m)
        assert (rng.binomial(m, 0.75, 20_000) < k).mean() < 1e-3
        assert 0 < k < m
    signs = np.random.default_rng(0).integers(0, 3, (50, 200)).astype(np.uint32)
    assert 7 in minhash.survivors(signs, signs[[7] * 50], minhash.fewest_matches(200, 40, 0.75, 1e-6))


def plain_sets(rows, size=5):
    out = []
    for key, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
        out.append((key, grams))
    return out


def corpus():
    rng = random.Random(9)
    words = [f"w{n}" for n in range(400)]
    rows, key = [], 0
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.choice([1, 1, 2, 8])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((key, rng.choice([" ", "\n", "\t "]).join(text)))
            key += 1
    passage = " ".join(rng.choices(words, k=40))
    rows += [(key + n, f"{passage} {' '.join(rng.choices(words, k=rng.randint(8, 20)))}") for n in range(60)]
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "Word"), (5004, "word"), (5004, "word"), (None, "word")]


def test_against_plain_sets(spark):
    rows = corpus()
    sets = plain_sets(rows)
    links = [
        (a, b)
        for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2)
        if a != b and x and 100 * len(x & y) >= 75 * len(x | y)
    ]
    want = roots({k for k, _ in sets if k is not None}, links)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(5)
    for block in (512, 7):
        got = minhash.near_duplicates(frame, block=block).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(k, v, k == v) for k, v in want.items()}
        sizes = dict((k, len(s)) for k, s in sets)
        assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    kept = minhash.keep_one(frame).collect()
    assert {r.doc_id for r in kept} == {k for k, v in want.items() if k == v} | {None}
    assert minhash.keep_one(frame).columns == frame.columns


def test_squares_join_what_is_similar(spark):
    """Members of one bucket in different components meet, whatever the block size; only joining links come out."""
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for n in range(60):
        base = np.random.default_rng(n % 3).integers(0, 2**63, 200).astype(np.uint64)
        extra = rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)
        sets[n] = np.unique(np.concatenate([base, extra]))
        sign = minhash.signature(sets[n], 200)
        rows.append((1, n, n if n < 50 else 0, bytearray(sign.tobytes()), sets[n].view(np.int64).tolist(), 60))
    schema = "bucket long, id long, component long, sig binary, hashes array<long>, many long"
    frame = spark.createDataFrame(rows, schema)
    links = [(a, b) for a, b in combinations(range(60), 2) if minhash.similar(sets[a], sets[b], 75)]
    given = [(n, 0) for n in range(50, 60)]
    limits = minhash.fewest_matches(200, 40, 0.75, 1e-6)
    for block in (4, 512):
        got = [(r.a, r.b) for r in minhash._across(frame, limits, block, 75).collect()]
        assert {tuple(sorted(p)) for p in got} <= set(links)
        assert roots(range(60), got + given) == roots(range(60), links + given)
        assert block == 4 or len(got) < 60


def test_similar():
    rng = random.Random(5)
    for _ in range(2000):
        a, b = ({rng.randrange(12) for _ in range(rng.randint(1, 12))} for _ in range(2))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert minhash.similar(x, y, 75) == (100 * len(a & b) >= 75 * len(a | b))


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cut_keeps_rows(spark):
    assert cut(spark.range(5)).count() == 5


def test_five_words_are_a_shingle_like_any_other(spark):
    rows = [(n, " ".join(["a"] * many)) for n, many in enumerate((5, 6, 9, 4))]
    assert minhash.shingles(b"a a a a a").tolist() == minhash.shingles(b"a a a a a a a").tolist()
    assert set(minhash.shingles(b"a b c d e")) < set(minhash.shingles(b"a b c d e f"))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (1, 3)}


def test_large_sets_are_cut_into_more_blocks(spark):
    rows = [(1, n, 1000, n % 3) for n in range(40)] + [(2, n, 3, n % 3) for n in range(40)] + [(3, n, 10**9, 0) for n in range(2)]
    frame = spark.createDataFrame([*rows, (4, 1, 10**9, 1), (4, 2, 10**9, 2)], "bucket long, id long, n long, component long")
    got = {(r.bucket, -(-r.many // 512)) for r in minhash._open_buckets(frame, 512, 4000).collect()}
    assert got == {(1, 10), (2, 1), (4, 2)}
    frame = spark.createDataFrame([r for r in corpus() if r[0] is not None], "doc_id long, text string")
    whole = sorted(minhash.near_duplicates(frame).collect())
    assert sorted(minhash.near_duplicates(frame, square_shingles=100).collect()) == whole
