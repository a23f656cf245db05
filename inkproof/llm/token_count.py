"""Token counts without ids: pieces once per distinct pre-token, joined to the frequencies of each document.

1. Every text becomes its pre-tokens; tasks send the distinct ones of a batch with their number, so a frequent one is a few rows.
2. The pieces of each distinct pre-token of the whole corpus are counted once, by the vocabulary's own merges.
3. The texts are read again and each becomes its pre-token frequencies, which are joined to the pieces and summed.  The join of
   the ``frequent`` pre-tokens that occur most is done in place, from a table of bounded size (each of at most ``_LONGEST`` bytes);
   a document's other frequencies are stored and joined by a shuffle.  Both give the same numbers.

Ids are never made.  Special strings are one token wherever they stand, the library's default.  A null text is empty: no bytes,
no tokens.  Texts are counted whole, rows are independent (ties and repeated rows give a row each, keys may be null), other columns
are not read, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import compress
from math import sumprod
from operator import not_

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkproof.llm.shared import binary_text, fresh, stored

#: Distinct pre-tokens that a task holds before it sends them on; changes the speed only.
_HELD = 200_000
_FREQUENT = 1 << 18
_LONGEST = 32


def _letters() -> dict[int, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


_LETTERS = _letters()


class PieceCounter:
    """Pre-tokens of texts, and their pieces under a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        # special strings are one token wherever they stand, the library's default
        self.special = sorted(
            (a.content for a in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True
        )
        self.bounds = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(pattern).findall

    def tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and how many special strings stand between them."""
        if self.bounds is None or not self.bounds.search(text):
            return self.find(text), 0
        parts = self.bounds.split(text)
        return [t for part in parts for t in self.find(part)], len(parts) - 1

    def pieces(self, token: str) -> int:
        return len(self.tokenizer.model.tokenize(token.encode().decode("latin-1").translate(_LETTERS)))


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PieceCounter:
    """One per Python worker."""
    return PieceCounter(path, pattern)


_PAIR = pa.schema([("token", pa.string()), ("times", pa.int64())])


def _distinct(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The stored (token, times, pieces) of every distinct pre-token."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = counter(path, pattern).tokens, Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    held.update(tokens(text)[0])
                if len(held) > _HELD:
                    yield pa.RecordBatch.from_arrays([list(held), list(held.values())], schema=_PAIR)
                    held = Counter()
        yield pa.RecordBatch.from_arrays([list(held), list(held.values())], schema=_PAIR)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = counter(path, pattern).pieces
        for batch in batches:
            yield pa.array([pieces(t) for t in batch.to_pylist()], pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    seen = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(split, "token string, times bigint")
    each = seen.groupBy("token").agg(F.sum("times").alias("times"))
    return stored(each.select("token", "times", F.arrow_udf(count, "bigint")(F.col("token")).alias("pieces")), "pre-tokens")


def _most_frequent(known: DataFrame, frequent: int) -> dict[str, int]:
    """Pieces of the pre-tokens that occur most: as many powers of two of their number as ``frequent`` rows allow."""
    short = known.where(F.octet_length("token") <= _LONGEST).withColumn("power", F.floor(F.log2("times")).cast("int"))
    taken, least = 0, None
    # at most 64 rows
    for row in sorted(short.groupBy("power").count().collect(), reverse=True):
        taken += row["count"]
        if taken > frequent:
            break
        least = row["power"]
    if least is None:
        return {}
    # at most ``frequent`` rows of at most ``_LONGEST`` bytes
    return {r.token: r.pieces for r in short.where(F.col("power") >= least).select("token", "pieces").collect()}


class _Settled(dict):
    """Pieces by pre-token; 0, which no pre-token has, where they are not known."""

    def __missing__(self, token: str) -> int:
        return 0


_SETTLED = "struct<tokens:bigint,rest:array<struct<token:string,times:bigint>>>"
_REST_TYPE = pa.struct([("token", pa.string()), ("times", pa.int64())])
_SETTLED_TYPE = pa.struct([("tokens", pa.int64()), ("rest", pa.list_(_REST_TYPE))])


def count_tokens(
    docs: DataFrame, path: str, pattern: str, *, keys: Sequence[str] = ("doc_id",), frequent: int = _FREQUENT
) -> DataFrame:
    """``keys``, ``n_bytes`` and ``n_tokens`` of each whole ``text`` under the ``.json`` vocabulary at ``path``, split by ``pattern``."""
    known = _distinct(docs, path, pattern)
    settled = docs.sparkSession.sparkContext.broadcast(_most_frequent(known, frequent))

    def settle(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, get = counter(path, pattern).tokens, _Settled(settled.value).__getitem__
        for batch in batches:
            totals, offsets, rest, times = [], [0], [], []
            for at in range(0, len(batch), 64):
                for text in batch[at : at + 64].to_pylist():
                    found, special = tokens(text)
                    found = Counter(found)
                    pieces = list(map(get, found))
                    totals.append(special + sumprod(pieces, found.values()))
                    some = list(compress(found, map(not_, pieces)))
                    rest += some
                    times += map(found.__getitem__, some)
                    offsets.append(len(rest))
            left = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], fields=list(_REST_TYPE))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left)
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), lists], fields=list(_SETTLED_TYPE))

    settle.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    row, found = fresh(docs, "row"), fresh(docs, "found")
    read = docs.select(
        *keys,
        F.monotonically_increasing_id().alias(row),
        F.octet_length(binary_text()).cast("long").alias("n_bytes"),
        F.arrow_udf(settle, _SETTLED)(F.coalesce("text", F.lit(""))).alias(found),
    )
    read = stored(read, "token-counts")
    rest = read.select(F.col(row).alias("of"), F.explode(f"{found}.rest").alias("each"))
    summed = rest.join(known, F.col("each.token") == F.col("token")).groupBy("of")
    summed = summed.agg(F.sum(F.col("each.times") * F.col("pieces")).alias("more"))
    total = F.col(f"{found}.tokens") + F.coalesce("more", F.lit(0))
    return read.join(summed, F.col(row) == F.col("of"), "left").select(*keys, "n_bytes", total.alias("n_tokens"))
