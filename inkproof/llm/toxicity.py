"""Toxic passages as maximum-scoring segments.

* **Tokens** (A-Z lower-cased runs of letters, digits and non-ASCII characters) and their first 3, 4, 5
  and 6 bytes are counted in ``2**bits`` hashed buckets, so the model has a fixed size whatever the vocabulary.
* **Log-odds** of toxic against clean documents have Dirichlet priors along the prefixes: the toxic share
  of a prefix is the prior, worth ``prior_tokens`` observations, of the next longer one, and the last one of the
  token.  So inflected and unseen forms of a word inherit its stem's odds, and a word that merely
  happens to stand in toxic documents is pulled to its stem's.  Tokens whose log-odds are below
  ``min_log_odds`` are neutral and cost ``gap_cost``.
* **Segments**: one scan in linear time finds all maximal-scoring segments of a document, so
  every toxic passage is found on its own and long clean text around it doesn't dilute it.
* **Extreme values**: the best segment of ``n`` clean tokens exceeds ``s`` with probability
  ``1 - exp(-K n exp(-lambda s))``.  ``lambda`` solves the Karlin-Altschul equation over the scores of clean
  tokens (where toxic ones imply a larger share of a score by their odds, that share counts), ``K`` is
  fitted to the clean documents.  Segments of an expected count of at most
  ``max_expected`` are significant.  A document's evidence aggregates all its segments by the law of their sums: the
  ``r`` best ones, whose normalised scores ``lambda s - ln(K n)`` add up to ``T``, are found by chance with probability
  ``exp(-T) T**(r-1) / (r! (r-1)!)``; minus the log of that, for the ``r`` at which it is largest, is the evidence.  A
  logistic curve over it gives the score.

The model is fitted on at most ``train_docs`` labelled documents (the documented bound; those
with the smallest hash of their id, half of them of each class as far as there are so many), weighted
to the classes' true shares.  Everything else covers all rows and whole texts.

Null and empty texts have no tokens; they get the score of no evidence and are never rejected.  Segments of equal score count
alike, the shortest, then first, is told.  Training labels that are
null don't count, repeated labels of a document count once (toxic if any row says so).  Without
training documents of both classes there is no model: every score is the share of toxic labels (0
without any).  Rows are independent, so repeated rows score alike; other columns are kept, whatever their names, and an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.shared import binary_text, fresh, stored

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of the prefixes that a token's odds are based on.
_PREFIXES = (3, 4, 5, 6)
#: Distinct tokens a task remembers before it starts anew; changes its speed only.
_REMEMBERED = 100_000
#: Evidence is binned so finely when the curve is fitted.
#: Evidence beyond this makes no difference.
_MOST = 200.0
_BINS_PER_UNIT = 8
#: Token scores up to 25 in steps of a quarter.
_SCORE_BINS = 101


class Model(NamedTuple):
    bits: int
    counts: np.ndarray | None  # tokens of (clean, toxic) documents in each bucket; None without a model
    totals: tuple[float, float]
    prior_tokens: float
    min_log_odds: float
    gap_cost: float
    decay: float  # lambda
    scale: float  # K
    slope: float
    offset: float
    max_expected: float


class Segment(NamedTuple):
    start: int  # tokens
    end: int
    score: float


def tokens(text: bytes) -> list[bytes]:
    return _TOKEN.findall(text.lower())


def buckets(token: bytes, bits: int) -> list[int]:
    """The buckets of a token's prefixes, shortest first, and of the token itself; repeated where it is short."""
    mask = (1 << bits) - 1
    return [*[zlib.crc32(token[:n]) & mask for n in _PREFIXES], zlib.crc32(b" " + token) & mask]


def log_odds(model: Model, token: bytes) -> float:
    clean_total, toxic_total = model.totals
    share = toxic_total / (clean_total + toxic_total)
    for bucket in buckets(token, model.bits):
        clean, toxic = model.counts[:, bucket].tolist()
        share = (toxic + model.prior_tokens * share) / (clean + toxic + model.prior_tokens)
    return math.log(share / (1 - share)) - math.log(toxic_total / clean_total)


class Weights:
    """Token → score, remembering what it has worked out."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, document: list[bytes]) -> list[float]:
        known, model = self.known, self.model
        if len(known) > _REMEMBERED:
            known.clear()
        for token in set(document).difference(known):
            odds = log_odds(model, token)
            known[token] = odds if odds >= model.min_log_odds else -model.gap_cost
        return [known[t] for t in document]


def maximal_segments(scores: list[float]) -> list[Segment]:
    """All maximal-scoring segments (no extension or part scores more), in one linear scan."""
    # candidates: start, end, total before it, total through it, the last earlier one whose left total is lower
    stack: list[list] = []
    total = 0.0
    for n, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [n, n + 1, before, total, -1]
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= new[2]:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= new[3]:
                new[4] = at
                stack.append(new)
                break
            new[0], new[2] = stack[at][0], stack[at][2]
            del stack[at:]
    return [Segment(s[0], s[1], s[3] - s[2]) for s in stack]


def evidence(model: Model, scores: list[float], many: int) -> float:
    """Minus the log of the chance that clean text of that length holds segments of such scores, at most ``_MOST``."""
    if not many:
        return 0.0
    expected = math.log(model.scale * many)
    each = sorted((v for v in (model.decay * s - expected for s in scores) if v > 0), reverse=True)
    best = total = 0.0
    for r, value in enumerate(each, 1):
        total += value
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return min(best, _MOST)


def score_of(model: Model, value: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * value + model.offset))))


def _counted(train: DataFrame, bits: int) -> np.ndarray:
    """Tokens of (clean, toxic) training documents in each bucket; partial counts per task, at most 2**bits rows in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                for token, many in Counter(tokens(text.as_py())).items():
                    for bucket in buckets(token, bits):
                        found[toxic, bucket] += many
        used = np.flatnonzero(found.any(axis=0))
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            columns = [pa.array(part), pa.array(found[0][part]), pa.array(found[1][part])]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "clean", "toxic"])

    each = train.mapInArrow(count, "bucket bigint, clean bigint, toxic bigint")
    table = each.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, 1 << bits), np.float32)
    out[:, table["bucket"].to_numpy()] = np.stack([table["clean"].to_numpy(), table["toxic"].to_numpy()])
    return out


def _histogram(train: DataFrame, shipped) -> np.ndarray:
    """Tokens of (clean, toxic) training documents by score, in steps of a quarter; the first are the neutral ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(pickle.loads(shipped.value))
        found = np.zeros((2, _SCORE_BINS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                scores = np.array(weights.of(tokens(text.as_py())), np.float64)
                place = np.clip(np.ceil(scores * 4), 0, _SCORE_BINS - 1).astype(int)
                found[toxic] += np.bincount(place, minlength=_SCORE_BINS)
        columns = [pa.array(np.arange(_SCORE_BINS)), pa.array(found[0]), pa.array(found[1])]
        yield pa.RecordBatch.from_arrays(columns, ["place", "clean", "toxic"])

    each = train.mapInArrow(count, "place bigint, clean bigint, toxic bigint")
    table = each.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, _SCORE_BINS))
    out[:, table["place"].to_numpy()] = np.stack([table["clean"].to_numpy(), table["toxic"].to_numpy()])
    return out


def _decay(histogram: np.ndarray, gap_cost: float) -> float:
    """The positive root of sum(share * exp(decay * score)) = 1 over the scores of clean tokens."""
    score = np.arange(_SCORE_BINS) / 4
    clean, toxic = histogram[0] / histogram[0].sum(), histogram[1] / histogram[1].sum()
    share = np.maximum(clean, toxic * np.exp(-score))
    share[0] = 1 - share[1:].sum()
    score[0] = -gap_cost
    low, high = 0.0, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * score, 700))).sum())
    while value(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def _curve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve over binned evidence."""
    weight, beta = toxic + clean, np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (toxic - weight * p) - ridge @ beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def training_sample(labels: DataFrame, fold: Column, train_docs: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``train_docs`` (doc_id, toxic) rows where ``fold`` holds, and how many there are of each class."""
    known = labels.where(fold & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    many = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == c).orderBy(*order).limit(train_docs // 2) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), many


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fold: Column | None = None,
    train_docs: int = 20_000,
    bits: int = 20,
    prior_tokens: float = 20.0,
    min_log_odds: float = 3.0,
    gap_cost: float = 0.15,
    max_expected: float = 0.01,
) -> Model:
    """Learn from the labelled documents for whose label rows ``fold`` holds (all by default)."""
    sample, many = training_sample(labels, F.lit(True) if fold is None else fold, train_docs)
    share = many.get(1, 0) / max(1, sum(many.values()))
    prior = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    fixed = (prior_tokens, min_log_odds, gap_cost)
    untrained = Model(bits, None, (0, 0), *fixed, 1.0, 1.0, 0.0, prior, max_expected)
    if not (many.get(0) and many.get(1)):
        return untrained
    # at most train_docs rows of two numbers: a bounded broadcast; the sample is stored, as it is read three times
    train = docs.select("doc_id", binary_text().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    train = stored(train, "toxic-sample")
    counts = _counted(train, bits)
    # every token is counted once per prefix and once itself
    totals = tuple((counts.sum(axis=1, dtype=np.float64) / (len(_PREFIXES) + 1)).tolist())
    if not all(totals):
        return untrained
    model = untrained._replace(counts=counts, totals=totals)
    shipped = _shipped(train, model)
    model = model._replace(decay=_decay(_histogram(train, shipped), gap_cost))
    best = stored(train.select("toxic", _segments(F.col("text"), shipped).alias("found")).select("toxic", "found.*"), "toxic-segments")
    # clean documents: K = documents / sum(n exp(-lambda s))
    null = F.col("n_tokens") * F.exp(-F.lit(model.decay) * F.coalesce(F.array_max("scores"), F.lit(0.0)))
    total = best.where("toxic = 0 and n_tokens > 0").agg(F.count("*").alias("n"), F.sum(null).alias("s")).first()
    model = model._replace(scale=total.n / total.s if total.n and total.s else 1.0)
    bins = best.groupBy(F.round(_evidence(F.col("scores"), F.col("n_tokens"), model) * _BINS_PER_UNIT).cast("long").alias("x")).agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")
    )
    bins = bins.toArrow()
    x, toxic, clean = (bins[c].to_numpy().astype(np.float64) for c in ("x", "toxic", "clean"))
    if not toxic.sum() or not clean.sum():
        return untrained
    toxic, clean = toxic * share / toxic.sum(), clean * (1 - share) / clean.sum()
    slope, offset = _curve(x / _BINS_PER_UNIT, toxic * sum(many.values()), clean * sum(many.values()))
    return model._replace(slope=slope, offset=offset)


def _shipped(frame: DataFrame, model: Model):
    """The model as a broadcast; its size is fixed by ``bits``."""
    return frame.sparkSession.sparkContext.broadcast(pickle.dumps(model))


_RESULT = "struct<n_tokens:bigint,best:double,score:double,passages:array<struct<start:int,end:int,score:double>>>"
_RESULT_TYPE = pa.struct(
    [
        ("n_tokens", pa.int64()),
        ("best", pa.float64()),
        ("score", pa.float64()),
        ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
    ]
)


def _places(text: bytes, segments: list[Segment]) -> list[dict]:
    """Token spans as spans of code points."""
    bounds = [m.span() for m in _TOKEN.finditer(text.lower())]
    out, at, seen = [], 0, 0
    for s in segments:
        a, b = bounds[s.start][0], bounds[s.end - 1][1]
        start = seen + len(text[at:a].decode("utf-8", "replace"))
        seen, at = start + len(text[a:b].decode("utf-8", "replace")), b
        out.append({"start": start, "end": seen, "score": s.score})
    return out


def judge(model: Model, weights: Weights, text: bytes) -> dict:
    """Tokens, best segment, score and significant passages of a text."""
    document = tokens(text)
    many = len(document)
    if model.counts is None or not many:
        return {"n_tokens": many, "best": 0.0, "score": score_of(model, 0.0), "passages": []}
    scores = weights.of(document)
    segments = maximal_segments(scores) if max(scores) > 0 else []
    best = max((s.score for s in segments), default=0.0)
    value = evidence(model, [s.score for s in segments], many)
    limit = -math.log(model.max_expected)
    strong = [s for s in segments if model.decay * s.score - math.log(model.scale * many) >= limit]
    return {
        "n_tokens": many,
        "best": best,
        "score": score_of(model, value),
        "passages": _places(text, strong) if strong else [],
    }


_SEGMENTS = "struct<n_tokens:bigint,scores:array<double>>"
_SEGMENTS_TYPE = pa.struct([("n_tokens", pa.int64()), ("scores", pa.list_(pa.float64()))])


def _segments(text: Column, shipped) -> Column:
    """Tokens and the scores of the segments of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(pickle.loads(shipped.value))
        for batch in batches:
            done = []
            for at in range(0, len(batch), 64):
                for document in map(tokens, batch[at : at + 64].to_pylist()):
                    scores = weights.of(document)
                    done.append({"n_tokens": len(document), "scores": [s.score for s in maximal_segments(scores)] if scores and max(scores) > 0 else []})
            yield pa.array(done, _SEGMENTS_TYPE)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _SEGMENTS)(text)


def _evidence(scores: Column, many: Column, model: Model) -> Column:
    small = model._replace(counts=None)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([evidence(small, *row) for row in zip(*(c.to_pylist() for c in batch))], pa.float64())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(scores, many)


def _scored(text: Column, shipped) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pickle.loads(shipped.value)
        weights = Weights(model)
        for batch in batches:
            done = [judge(model, weights, v) for at in range(0, len(batch), 64) for v in batch[at : at + 64].to_pylist()]
            yield pa.array(done, _RESULT_TYPE)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _RESULT)(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with ``toxicity`` (n_tokens, best, score, passages in code points), replacing a column of that name."""
    return docs.withColumn("toxicity", _scored(binary_text(), _shipped(docs, model)))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold or have no tokens, with their columns as they were."""
    found = fresh(docs, "found")
    judged = docs.withColumn(found, _scored(binary_text(), _shipped(docs, model)))
    return judged.where((F.col(found)["score"] < threshold) | (F.col(found)["n_tokens"] == 0)).select(docs.columns)
