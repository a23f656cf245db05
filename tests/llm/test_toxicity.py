"""Segments against brute force; the whole on labelled data held out."""

import math
import random

from pyspark.sql import functions as F

from inkproof.llm import toxicity
from inkproof.llm.queries import op9_toxicity

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def brute_segments(scores):
    """The recursive definition: the best segment (of equals the shortest, then the first), then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 0 and (best is None or (total, i - j) > (best[0], best[1] - best[2])):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    right = [(a + j, b + j) for a, b in brute_segments(scores[j:])]
    return [*brute_segments(scores[:i]), (i, j), *right]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [(s.start, s.end) for s in toxicity.maximal_segments(scores)] == brute_segments(scores)


def test_linear_time():
    assert len(toxicity.maximal_segments([1.0, -2.0] * 200_000)) == 200_000


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op9_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == c] for c in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 for r in rows)


def _trained(spark, labels):
    texts = [(n, f"awful horrid vile number {n}" if n % 4 == 0 else f"kind gentle mild number {n}") for n in range(80)]
    docs = spark.createDataFrame([*texts, (100, None), (101, ""), (102, "x " * 500 + "vile awful horrid " * 3 + "y " * 500), (None, "vile")], SCHEMA)
    return docs, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))


def test_passages_nulls_and_repeats(spark):
    labels = [(n, 1, int(n % 4 == 0)) for n in range(80)] * 2 + [(None, 1, 1), (5, None, None)]
    docs, model = _trained(spark, labels)
    rows = {r.doc_id: r.toxicity for r in toxicity.score(docs.withColumn("toxicity", F.lit(1)), model).collect()}
    assert rows[0].score >= 0.5 > rows[1].score
    assert rows[100].score == rows[101].score < 0.5 and rows[100].n_tokens == 0
    text = "x " * 500 + "vile awful horrid " * 3 + "y " * 500
    assert [text[p.start : p.end].split() for p in rows[102].passages] == [["vile", "awful", "horrid"] * 3]
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()}
    assert 1 in kept and 100 in kept and 0 not in kept


def plain_evidence(model, scores, many):
    """The r best, for every r, by factorials."""
    each = sorted((model.decay * s - math.log(model.scale * many) for s in scores), reverse=True)
    each = [v for v in each if v > 0]
    chances = [math.exp(-sum(each[:r])) * sum(each[:r]) ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) for r in range(1, len(each) + 1)]
    return -math.log(min(chances, default=1.0))


def test_evidence_adds_up_all_segments():
    model = toxicity.Model(4, None, (0, 0), 20.0, 3.0, 0.15, 0.8, 0.3, 1.0, 0.0, 0.01)
    rng = random.Random(1)
    for _ in range(300):
        scores, many = [rng.uniform(0, 30) for _ in range(rng.randint(0, 6))], rng.randint(1, 2000)
        want = max(plain_evidence(model, scores, many), 0.0)
        assert abs(toxicity.evidence(model, scores, many) - min(want, 200)) < 1e-6
    one, three = (toxicity.evidence(model, [12.0] * n, 50) for n in (1, 3))
    assert three > 2 * one > 0 == toxicity.evidence(model, [], 50) == toxicity.evidence(model, [9.0], 0)


def test_texts_without_tokens_are_never_rejected(spark):
    docs, model = _trained(spark, [(n, 1, 1) for n in range(80)])
    kept = [r.doc_id for r in toxicity.reject_toxic(docs, model).collect()]
    assert sorted(kept) == [100, 101]


def test_counts_of_the_model(spark):
    """Counts, totals, scale and decay of a small sample, each worked out plainly."""
    labels = [(n, 1, int(n % 4 == 0)) for n in range(80)]
    docs, model = _trained(spark, labels)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 80").collect()}
    clean, toxic = ([t for n, t in texts.items() if (n % 4 == 0) == kind] for kind in (False, True))
    assert model.totals == tuple(float(sum(len(t.split()) for t in kind)) for kind in (clean, toxic))
    for word in (b"vile", b"gentle"):
        whole = toxicity.buckets(word, model.bits)[-1]
        for row, kind in enumerate((clean, toxic)):
            assert model.counts[row][whole] == sum(t.split().count(word.decode()) for t in kind)
    weights = toxicity.Weights(model)
    best = [max((s.score for s in toxicity.maximal_segments(weights.of(toxicity.tokens(t.encode())))), default=0.0) for t in clean]
    sums = sum(len(t.split()) * math.exp(-model.decay * b) for t, b in zip(clean, best))
    assert abs(model.scale - len(clean) / sums) < 1e-9


def test_very_long_text_and_repeated_rows(spark):
    docs, model = _trained(spark, [(n, 1, int(n % 4 == 0)) for n in range(80)])
    long = "kind gentle words " * 200_000
    rows = [(1, long), (2, long + "vile awful horrid " * 5), (2, long + "vile awful horrid " * 5)]
    got = [(r.doc_id, r.toxicity.score >= 0.5, r.toxicity.n_tokens) for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()]
    assert sorted(got) == [(1, False, 600_000), (2, True, 600_015), (2, True, 600_015)]


def test_without_a_class(spark):
    for labels, share in (([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0), ([], 0.0)):
        docs, model = _trained(spark, labels)
        assert all(abs(r.toxicity.score - share) < 1e-6 for r in toxicity.score(docs, model).collect())
