"""Ranked lexical search: the best documents of each query by intervals of documents and range maxima.

A term is a run of letters, digits and non-ASCII characters of the whole text, A-Z lower-cased.  With N documents that
have terms, L terms in all, n terms in a document and df documents that hold a term, a term weighs
w = floor(1000 ln((2N+2)/(2df+1))) and a document counts m = 75 + 25nN div L; a term found tf times adds
w * (10**9 tf div (1000 tf + 12 m)), its impact, as often as the query says it.

1. ``read`` goes once over the texts.  Terms that no query has are dropped in the task by a bit table of fixed size
   (``slots`` bytes, whatever the queries are), so few others are left; the rest, and n of every document, are stored.
2. Statistics, weights and impacts come from the stored table by joins that Spark plans by size.
3. Documents are dealt into shards of about ``shard_postings`` postings and queries into blocks of about ``block_terms``
   terms.  A task has one shard and one block: posting lists by document, and a sparse table of range maxima over
   them.  Of each query, the interval of documents whose range maxima add up to most is taken first.  It is
   split at the document of its largest impact, which is scored exactly; the maxima of both parts bound them.  Intervals of few
   postings are scored whole.  When no bound reaches the k-th score, the rest of the shard can't hold a result.
4. The best of the shards are merged by a ranking that keeps k rows of a query per task before it shuffles.

No list, query or document is cut short: every shard gives all of its documents that may be among the k best.

Every row of ``docs`` is a document: repeated rows are documents of the same id and text, each with a rank of its own.
Null and wordless texts have no terms and are not counted in N.  Rows of one query id are one query with all their terms (a row
repeated in full counts once); queries without an id, or without a term that occurs, get no rows.  Equal scores go by
ascending doc_id, null ids last; documents of the same id and score are alike.  Texts are read whole, other columns are not
read, and empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkproof.llm.shared import stored

#: UTF-8 form of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ after lower-casing.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHARD_POSTINGS = 500_000
_BLOCK_TERMS = 100_000
_SLOTS = 1 << 20
#: Intervals of at most so many postings are scored whole; changes the speed only.
_WHOLE = 4096

_TERMS = "struct<n:bigint,terms:array<binary>,tfs:array<int>>"
_TERMS_TYPE = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.binary())), ("tfs", pa.list_(pa.int32()))])


def _term_counts(text: Column, kept: bytes | None = None) -> Column:
    """struct(n, terms, tfs) of each whole text; with ``kept``, of the terms whose slot is set."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            totals, lengths, terms, tfs = [], [0], [], []
            for at in range(0, len(batch), 64):
                for value in batch[at : at + 64].to_pylist():
                    found = Counter(_TERM.findall(value.lower()))  # bytes: A-Z only
                    totals.append(found.total())
                    if kept is None:
                        some = found
                    else:
                        last = len(kept) - 1
                        some = [t for t in found if kept[crc32(t) & last]]
                    terms += some
                    tfs += [found[t] for t in some]
                    lengths.append(len(terms))
            offsets = pa.array(lengths, pa.int32())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(totals, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                fields=list(_TERMS_TYPE),
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _TERMS)(F.coalesce(text.cast("binary"), F.lit(b"")))


def _query_terms(queries: DataFrame) -> DataFrame:
    """The stored (item_id, term, times) of the queries."""
    rows = queries.select("item_id", "text").where("item_id is not null").distinct()
    found = rows.select("item_id", _term_counts(F.col("text")).alias("found"))
    each = found.select("item_id", F.explode(F.arrays_zip("found.terms", "found.tfs")).alias("each"))
    times = F.sum(F.col("each.tfs").cast("long")).alias("times")
    return stored(each.groupBy("item_id", F.col("each.terms").alias("term")).agg(times), "search-queries")


def _kept_slots(terms: DataFrame, slots: int) -> bytes:
    """A byte per slot, 1 where a term of a query falls; at most ``slots`` numbers come to the driver."""
    rows = terms.select((F.crc32("term") % slots).cast("int").alias("slot")).distinct()
    kept = bytearray(slots)
    for row in rows.toLocalIterator():
        kept[row.slot] = 1
    return bytes(kept)


def read(docs: DataFrame, terms: DataFrame, slots: int = _SLOTS) -> DataFrame:
    """The stored (key, doc_id, n, terms, tfs) of every document: all its terms counted, those of queries listed."""
    if slots < 1 or slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    found = _term_counts(F.col("text"), _kept_slots(terms, slots)).alias("found")
    rows = docs.select("doc_id", found).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "found.n", "found.terms", "found.tfs"
    )
    return stored(rows, "search-documents")


def _postings(read: DataFrame) -> DataFrame:
    each = read.select("key", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("each"))
    return each.select("key", "doc_id", "n", F.col("each.terms").alias("term"), F.col("each.tfs").cast("long").alias("tf"))


def _weights(read: DataFrame, terms: DataFrame, documents: int, blocks: int) -> DataFrame:
    """The stored (term, number, weight, block): a row per block of queries that has the term."""
    held = _postings(read).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2.0 * documents + 2.0) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(1000 * F.log(ratio)).cast("long").alias("weight")
    known = terms.select("term").distinct().join(held, "term")
    numbered = stored(known.select("term", F.monotonically_increasing_id().alias("number"), weight), "search-weights")
    wanted = terms.select("term", _block(blocks)).distinct()
    return numbered.join(wanted, "term")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")


class Shard:
    """Posting lists of a shard, by term number, and the sparse table of their range maxima."""

    def __init__(self, numbers: np.ndarray, documents: np.ndarray, impacts: np.ndarray, size: int):
        order = np.lexsort((documents, numbers))
        self.size = size  # documents are numbered below it
        self.documents, self.impacts = documents[order], impacts[order]
        self.numbers, first = np.unique(numbers[order], return_index=True)
        self.ends = np.append(first, len(order))
        lists = np.repeat(np.arange(len(self.numbers)), np.diff(self.ends))
        self.places = lists * size + self.documents  # ascending: list, then document
        longest = int(np.diff(self.ends).max(initial=1))
        # a row per power of two: where the largest impact of that many postings from a place on stands
        table = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(table) - 1) <= longest:
            step, last = 1 << (len(table) - 1), table[-1]
            left, right = last[: len(last) - step], last[step:]
            best = np.where(self.impacts[right] > self.impacts[left], right, left)
            table.append(np.concatenate([best, last[len(last) - step :]]))
        self.table = np.stack(table)
        self.power = np.frexp(np.arange(longest + 1))[1].astype(np.int64) - 1  # of two, rounded down

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those numbers that the shard has among its lists, and which of ``numbers`` they are."""
        at = np.searchsorted(self.numbers, numbers)
        there = np.flatnonzero(at < len(self.numbers))
        there = there[self.numbers[at[there]] == numbers[there]]
        return at[there], there

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The posting of the largest impact in each of some ranges, none of them empty."""
        power = self.power[high - low]
        left, right = self.table[power, low], self.table[power, high - (1 << power)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def best(self, numbers: np.ndarray, times: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, -document) of the k best documents of a query, in no order; fewer if fewer score above 0."""
        lists, there = self.lists(numbers)
        base, times = lists * self.size, times[there]
        kept: list[tuple[int, int]] = []
        waiting: list = []
        order = count()

        def keep(score: int, document: int) -> None:
            if score > 0:
                if len(kept) < k:
                    heappush(kept, (score, -document))
                elif (score, -document) > kept[0]:
                    heapreplace(kept, (score, -document))

        def wait(first: int, end: int, mine: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            """Put the documents from ``first`` to ``end`` on the list, with the ranges of the lists that reach them."""
            some = high > low
            if not some.any():
                return
            mine, low, high = mine[some], low[some], high[some]
            at = self.largest(low, high)
            most = self.impacts[at] * times[mine]
            bound = int(most.sum())
            if bound > 0 and (len(kept) < k or (bound, -first) > kept[0]):
                heappush(waiting, (-bound, first, next(order), end, mine, low, high, at[most.argmax()]))

        wait(0, self.size, np.arange(len(lists)), self.ends[lists], self.ends[lists + 1])
        while waiting:
            bound, first, _, end, mine, low, high, at = heappop(waiting)
            if len(kept) == k and (-bound, -first) < kept[0]:
                # ties in the bound may still hold an earlier document
                if -bound < kept[0][0]:
                    break
                continue
            if int((high - low).sum()) <= _WHOLE:
                self._whole(mine, low, high, times, keep, kept, k)
                continue
            middle = int(self.documents[at])
            cut = np.searchsorted(self.places, base[mine] + middle)
            cut = np.minimum(np.maximum(cut, low), high)
            last = np.minimum(cut, len(self.places) - 1)
            has = (cut < high) & (self.places[last] == base[mine] + middle)
            keep(int((self.impacts[last[has]] * times[mine[has]]).sum()), middle)
            wait(first, middle, mine, low, cut)
            wait(middle + 1, end, mine, cut + has, high)
        return kept

    def _whole(self, mine: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray, keep, kept: list, k: int) -> None:
        """Score every document of an interval."""
        many = high - low
        at = np.arange(many.sum()) + np.repeat(low - np.concatenate([[0], many.cumsum()[:-1]]), many)
        documents, scores = self.documents[at], self.impacts[at] * np.repeat(times[mine], many)
        order = np.argsort(documents, kind="stable")
        documents = documents[order]
        starts = np.flatnonzero(np.diff(documents, prepend=-1))
        totals = np.add.reduceat(scores[order], starts)
        documents = documents[starts]
        if len(kept) == k:
            some = totals >= kept[0][0]
            totals, documents = totals[some], documents[some]
        if len(totals) > k:
            # those below the k-th largest of the interval itself can't be among the k best either
            some = totals >= np.partition(totals, len(totals) - k)[len(totals) - k]
            totals, documents = totals[some], documents[some]
        for score, document in zip(totals.tolist(), documents.tolist()):
            keep(score, document)


_BEST = "item_id bigint, doc_id bigint, score bigint"
_BEST_TYPE = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if postings.num_rows and queries.num_rows:
            keys, at = np.unique(postings["key"].to_numpy(), return_index=True)
            ids = postings["doc_id"].take(pa.array(at)).to_pylist()
            # documents by id, null ids last: the earlier of equal scores is the one to keep
            order = sorted(range(len(keys)), key=lambda n: (ids[n] is None, ids[n] or 0))
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            documents = place[np.searchsorted(keys, postings["key"].to_numpy())]
            shard = Shard(postings["number"].to_numpy(), documents, postings["impact"].to_numpy(), len(keys))
            asked = queries["asked"].combine_chunks().flatten()
            items, numbers, times = (asked.field(c).to_numpy() for c in ("item_id", "number", "times"))
            by_item = np.argsort(items, kind="stable")
            for mine in np.split(by_item, np.flatnonzero(np.diff(items[by_item])) + 1):
                for score, document in shard.best(numbers[mine], times[mine], k):
                    out.append((int(items[mine[0]]), ids[order[-document]], score))
        columns = list(zip(*out)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_BEST_TYPE)

    return run


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_postings: int = _SHARD_POSTINGS,
    block_terms: int = _BLOCK_TERMS,
    slots: int = _SLOTS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each query (item_id, text)."""
    if min(k, shard_postings, block_terms) < 1:
        raise ValueError("k, shard_postings and block_terms must be positive")
    terms = _query_terms(queries)
    seen = read(docs, terms, slots)
    # two numbers and a sum
    documents, total, many = seen.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
    shards, blocks = 1 + (many or 0) // shard_postings, 1 + terms.count() // block_terms
    weights = _weights(seen, terms, documents, blocks)
    # decimals: n times N may pass 64 bits
    share = F.expr(f"cast((25 * cast(n as decimal(20,0)) * {documents}) div {max(total or 0, 1)} as bigint)")
    impact = F.expr("weight * ((1000000000 * tf) div (1000 * tf + 12 * m))").alias("impact")
    postings = (
        _postings(seen)
        .withColumn("m", 75 + share)
        .join(weights, "term")
        .select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "block", "key", "doc_id", "number", impact)
    )
    # every shard gets the terms of its block of queries, a row per block
    packed = (
        terms.withColumn("block", _block(blocks))
        .join(weights.select("term", "block", "number"), ["term", "block"])
        .groupBy("block")
        .agg(F.collect_list(F.struct("item_id", "number", "times")).alias("asked"))
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    asked = packed.select(F.explode(every).alias("shard"), "block", "asked")
    best = postings.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k), _BEST)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
