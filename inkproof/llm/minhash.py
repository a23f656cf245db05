"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts whose word sequences are equal are one class (its representative is the smallest id), so
   thousands of copies cost one row from here on.
2. Each class has a MinHash signature of its set of hashed word shingles, stored once.  A band of a
   signature is a bucket; classes that share one are candidates.
3. In every bucket each class meets the bucket's smallest class: linear in the bucket.  What is linked
   by then needs no further comparison inside its component.
4. Classes of a bucket that are still in different components meet each other, in square blocks of about
   ``block`` members (fewer where more than about ``square_shingles`` shingles would meet in a block), one
   group each: no bucket is gathered whole.  Pairs are compared and verified inside the
   block until their components are joined, and only the joining links leave it.
5. A pair is compared in batches of signature rows.  After each batch the posterior of its
   similarity (uniform prior) is bounded: if it reaches the threshold with a probability below
   ``miss`` the pair is dropped.  Survivors are verified exactly on their full shingle sets
   (of 64-bit hashes), which are made only for the documents that occur in them; up to ``broadcast_ids`` of
   these are sent to the scan of the texts, more are joined with it.

A pair of exactly the threshold 0.75 is missed by all of 40 bands of 5 rows with probability 2e-5.

Words are the runs of non-white-space after A-Z are lower-cased; fewer words than a shingle make one
shingle; null, empty and blank texts have an empty set and link with nothing.  Rows with a null
id keep their counts but link with nothing; rows that repeat an id and its text are one document,
and return as often as they came.  Texts count whole, extra columns are not read, and an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.graph import components
from inkproof.llm.shared import binary_text, cut, fresh, key_exchange, stored


def words(text: bytes) -> list[bytes]:
    """bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    many = words(text)
    if not many:
        return np.empty(0, np.uint64)
    if len(many) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(many))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    known: dict[bytes, int] = {}
    for word in set(many):
        known[word] = digest(word)
    hashed = np.fromiter(map(known.__getitem__, many), np.uint64, len(many))
    # a polynomial of the words' 64-bit hashes, mixed
    out = np.zeros(len(many) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=4)
def _permutations(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the permutations of 32-bit numbers, from fixed digests."""
    raw = b"".join(hashlib.sha256(b"row %d" % n).digest()[:8] for n in range(rows))
    pairs = np.frombuffer(raw, "<u4").reshape(rows, 2)
    return (pairs[:, 0] | np.uint32(1))[:, None], pairs[:, 1].copy()[:, None]


def signature(hashes: np.ndarray, rows: int) -> np.ndarray:
    """The smallest value of a set under each permutation; in parts that stay in the processor's cache."""
    a, b = _permutations(rows)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 256):
        values = folded[None, at : at + 256] * a
        values += b
        np.minimum(out, values.min(axis=1), out=out)
    return out


@lru_cache(maxsize=8)
def fewest_matches(rows: int, batch: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """For each prefix of signature rows, the fewest matches that keep a pair.

    With a uniform prior, k matches of m rows give P(similarity >= t) = P(Binomial(m + 1, t) <= k).
    """
    out = []
    for m in range(batch, rows + 1, batch):
        tail, k = 0.0, -1
        while k < m:
            k += 1
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= miss:
                break
        out.append((m, k))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, limits: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Places of the pairs (rows of two signature matrices) that no batch prunes."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    start = 0
    for end, fewest in limits:
        matches[alive] += (left[alive, start:end] == right[alive, start:end]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= fewest]
        start = end
        if not len(alive):
            break
    return alive


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


_SKETCH = "struct<key:string,n:bigint,sig:binary>"


def _sketch(text: Column, size: int, rows: int) -> Column:
    """A digest of the word sequence (null without words), the size of the shingle set and its signature."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, bytes]] = {}
        for batch in batches:
            keys, many, signs = [], [], []
            for at in range(0, len(batch), 64):
                for value in batch[at : at + 64].to_pylist():
                    key = digest(value)
                    if key not in known:
                        found = shingles(value, size)
                        known[key] = len(found), signature(found, rows).tobytes() if len(found) else b""
                    keys.append(key)
                    many.append(known[key][0])
                    signs.append(known[key][1])
                if len(known) > 5_000:
                    known.clear()
            columns = [pa.array(keys, pa.string()), pa.array(many, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.StructArray.from_arrays(columns, ["key", "n", "sig"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _SKETCH)(text)


_SET = "struct<key:string,hashes:array<bigint>>"


def _keyed_set(text: Column, size: int) -> Column:
    """The digest of the word sequence and the shingle set of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys, sets = [], []
            for at in range(0, len(batch), 64):
                for value in batch[at : at + 64].to_pylist():
                    keys.append(digest(value))
                    sets.append(shingles(value, size))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(ends, flat)], ["key", "hashes"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # declared non-deterministic, which it is not: else a filter on it is pushed below the join that narrows the rows
    return F.arrow_udf(run, _SET).asNondeterministic()(text)


def digest(text: bytes) -> str | None:
    joined = b" ".join(words(text))
    return hashlib.blake2b(joined, digest_size=16).hexdigest() if joined else None


def word_key(text: Column) -> Column:
    """A digest of the word sequence of a text, null if it has no words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 64):
                out += map(digest, batch[at : at + 64].to_pylist())
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def _bands(sig: Column, bands: int, rows: int) -> Column:
    """The bucket of each band: its number and its rows' bytes."""
    width = 4 * rows
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda n: F.xxhash64(n, F.substring(sig, n * width + 1, F.lit(width))),
    )


def _pruned(left: Column, right: Column, limits: tuple) -> Column:
    """Whether the pair of signatures survives the batches."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 1000):
                x, y = (_matrix(v[at : at + 1000].to_pylist()) for v in (a, b))
                if len(x):
                    keep[at + survivors(x, y, limits)] = True
            yield pa.array(keep)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(left, right)


def _matrix(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), "<u4").reshape(len(signs), -1) if signs else np.empty((0, 0), np.uint32)


def _sets_of(ids: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, broadcast_ids: int) -> DataFrame:
    """(id, hashes) of the classes of ``ids`` (id), stored."""
    involved = stored(nodes.select("id", "key").join(ids.distinct(), "id", "left_semi"), "involved")
    few = F.broadcast(involved) if involved.count() <= broadcast_ids else involved
    own = texts.join(few, F.col("doc_id") == F.col("id")).withColumn("own", _keyed_set(F.col("text"), size))
    # rows that repeat an id and a text have one set; another text of the id isn't the class's
    sets = own.where("own.key = key").groupBy("id").agg(F.any_value("own.hashes").alias("hashes"))
    return stored(sets, "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, sets_of: Callable, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    # pairs whose sizes alone forbid it need no sets
    one, two = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    possible = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = stored(pairs.join(one, "a").join(two, "b").where(possible), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")))
    one, two = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("h_a", "h_b")))
    return both.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _bayes(pairs: DataFrame, nodes: DataFrame, limits: tuple) -> DataFrame:
    """The pairs (a, b) that the batches leave."""
    one = nodes.select(F.col("id").alias("a"), F.col("sig").alias("s_a"))
    two = nodes.select(F.col("id").alias("b"), F.col("sig").alias("s_b"))
    return pairs.join(one, "a").join(two, "b").where(_pruned(F.col("s_a"), F.col("s_b"), limits)).select("a", "b")


class Components:
    """Union-find over the components that meet in a square."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, n: int) -> int:
        while n in self.parent:
            n = self.parent[n]
        return n

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    few, many = (left, right) if len(left) <= len(right) else (right, left)
    if 100 * len(few) < percent * len(many):
        return False
    place = np.searchsorted(many, few)
    place[place == len(many)] = 0
    shared = int((many[place] == few).sum())
    return 100 * shared >= percent * (len(few) + len(many) - shared)


def square_links(
    ids: np.ndarray, group: np.ndarray, signs: np.ndarray, sets: list, left: np.ndarray, right: np.ndarray, limits: tuple, percent: int
) -> list[tuple[int, int]]:
    """Verified links between rows ``left`` and ``right`` that join different components, as few as join them.

    Every pair of different components is compared until a link joins them; no link, no join.
    """
    known, out = Components(), []
    roots = group.copy()
    for one in left:
        others = right[roots[right] != roots[one]]
        if not len(others):
            continue
        kept = others[survivors(np.broadcast_to(signs[one], (len(others), signs.shape[1])), signs[others], limits)]
        if not len(kept):
            continue
        nearest = np.argsort(-(signs[kept] == signs[one]).sum(axis=1), kind="stable")
        for other in kept[nearest]:
            if known.root(group[one]) != known.root(group[other]) and similar(sets[one], sets[other], percent):
                out.append((int(ids[one]), int(ids[other])))
                known.join(int(group[one]), int(group[other]))
                roots = np.array([known.root(int(g)) for g in group])
    return out


def _across(members: DataFrame, limits: tuple, block: int, percent: int) -> DataFrame:
    """Links between members of a bucket (bucket, id, component, sig, hashes, many) in different components."""
    blocks = F.ceil(F.col("many") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # a member goes to the squares of its row and its column; a bucket of one block has one square
    squares = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(mine, other).alias("row"), F.greatest(mine, other).alias("column")),
    )
    dealt = members.withColumn("mine", mine).withColumn("square", F.explode(squares))

    def compare(table: pa.Table) -> pa.Table:
        hashes = table["hashes"].combine_chunks()
        ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
        sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
        place = table["mine"].to_numpy()
        row, column = table["row"][0].as_py(), table["column"][0].as_py()
        left, right = np.flatnonzero(place == row), np.flatnonzero(place == column)
        ids, group = table["id"].to_numpy(), table["component"].to_numpy()
        found = square_links(ids, group, _matrix(table["sig"].to_pylist()), sets, left, right, limits, percent)
        return pa.table({c: pa.array([f[n] for f in found], pa.int64()) for n, c in enumerate("ab")})

    flat = dealt.select("bucket", "square.row", "square.column", "mine", "id", "component", "sig", "hashes")
    return flat.groupBy("bucket", "row", "column").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    size: int = 5,
    bands: int = 40,
    rows: int = 5,
    batch: int = 40,
    miss: float = 1e-6,
    block: int = 512,
    broadcast_ids: int = 1_000_000,
    square_shingles: int = 16_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text), one row per row."""
    limits = fewest_matches(bands * rows, batch, percent / 100, miss)
    keyed = docs.select("doc_id", word_key(binary_text()).alias("key"))
    sketch = _sketch(binary_text(), size, bands * rows)
    sketched = docs.select("doc_id", sketch.alias("s")).select("doc_id", "s.*").where("key is not null")
    classes = sketched.groupBy("key").agg(
        F.min("doc_id").alias("id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")
    )
    classes = stored(classes, "classes")
    nodes = classes.where("id is not null")
    texts = docs.select("doc_id", binary_text().alias("text"))
    sets_of = partial(_sets_of, nodes=nodes, texts=texts, size=size, broadcast_ids=broadcast_ids)
    found = _class_components(nodes, sets_of, percent, bands, rows, limits, block, square_shingles)
    labelled = classes.select("key", "id", "n").join(found, "id", "left")
    labelled = labelled.select(key_exchange("key").alias("k"), "n", F.coalesce("component", "id").alias("component"))
    out = keyed.join(labelled, key_exchange("key") == F.col("k"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _open_buckets(grouped: DataFrame, block: int, square_shingles: int) -> DataFrame:
    """(bucket, id, component, many) of the buckets (bucket, id, n, component) that hold several components.

    ``many`` is the number of members, or so much larger that a block holds about ``square_shingles`` shingles.
    """
    blocks = F.least(F.ceil(F.sum("n") / square_shingles), F.count("*"))
    open_ones = grouped.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.greatest(F.count("*"), blocks * block).alias("many")
    )
    open_ones = open_ones.where("low < high").select((F.col("bucket").bitwiseXOR(F.lit(1))).alias("other"), "many")
    rest = grouped.join(open_ones, F.col("bucket").bitwiseXOR(F.lit(1)) == F.col("other"))
    return rest.select("bucket", "id", "component", "many")


def _class_components(
    nodes: DataFrame, sets_of: Callable, percent: int, bands: int, rows: int, limits: tuple, block: int, square_shingles: int
) -> DataFrame:
    """(id, component) of the classes that are linked with another."""
    placed = nodes.select("id", "n", F.explode(_bands(F.col("sig"), bands, rows)).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    shared = shared.select((F.col("bucket").bitwiseXOR(F.lit(1))).alias("other"), "pivot")
    met = placed.join(shared, F.col("bucket").bitwiseXOR(F.lit(1)) == F.col("other"))
    members = stored(met.select("bucket", "id", "n", "pivot"), "members")

    first = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(_verified(_bayes(first, nodes, limits), nodes, sets_of, percent), "links")
    grouped = members.join(components(links), "id", "left")
    grouped = cut(grouped.select("bucket", "id", "n", F.coalesce("component", "id").alias("component")))

    rest = stored(_open_buckets(grouped, block, square_shingles), "open-buckets")
    full = nodes.select("id", "sig").join(sets_of(rest.select("id")), "id")
    more = _across(rest.join(full, "id"), limits, block, percent)
    return components(links.unionAll(more))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows that repeat its id and text stay."""
    judged = near_duplicates(docs, **options).where("kept or doc_id is null or n_shingles = 0")
    own = fresh(docs, "own")
    judged = judged.select(F.col("doc_id").alias(own)).distinct()
    return docs.join(judged, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
