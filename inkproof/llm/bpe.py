"""Byte-level BPE through a sentencepiece model made from a rank vocabulary.

The model is serialised straight from the ranks: each byte of a token stands as one letter of a
256-letter alphabet, a piece scores minus its rank, and the normaliser is the identity.
Sentencepiece then merges the pair of the best (lowest-rank) piece first, leftmost first, which is
what a rank file means.  Texts are split by the vocabulary's pattern, each match is encoded apart,
and decoding is the inverse table.

Nulls are empty texts: no ids, decoded to no bytes.  A text of any length is encoded whole; rows
are independent, so ties, repeated rows and extra columns have no effect, and an empty table gives
an empty table.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of the bytes start here: no white space, nothing that a normaliser would touch.
_FIRST_LETTER = 0x100
#: Distinct pre-tokens a task remembers before it starts anew; changes its speed only.
_REMEMBERED = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its rank on each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def letters(token: bytes) -> str:
    """Each byte as its letter."""
    return "".join([chr(_FIRST_LETTER + b) for b in token])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model proto whose piece ``i`` is the token of the ``i``-th lowest rank."""
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        pieces.append(_message(1, _message(1, letters(token).encode()) + b"\x15" + struct.pack("<f", -rank)))
    unknown = _message(1, _message(1, b"<unk>") + b"\x18\x02")  # type 2: unknown
    trainer = _message(2, b"\x18\x02")  # model type 2: BPE
    # identity; no dummy prefix, extra white space kept, white space not escaped
    normaliser = _message(3, _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00")
    return b"".join([*pieces, unknown, trainer, normaliser])


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).finditer
        self.find = regex.compile(pattern).findall
        self.order = sorted(ranks.values())
        self.token = {rank: token for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self._packed: dict[str, bytes] = {}

    def encode_piece(self, text: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        token = text.encode()
        whole = self.ranks.get(token)
        if whole is not None:
            return struct.pack("<I", whole)
        ids = self.model.encode(letters(token))
        return struct.pack(f"<{len(ids)}I", *[self.order[i] for i in ids])

    def encode(self, text: str) -> bytes:
        packed, out = self._packed, []
        if len(packed) > _REMEMBERED:
            packed.clear()
        for match in self.split(text):
            piece = match.group()
            ids = packed.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    packed[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Raises KeyError for an id the vocabulary lacks."""
        return b"".join([self.token[i] for i, in struct.iter_unpack("<I", ids)])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; one per Python worker."""
    return Codec(read_ranks(path), pattern)


def _mapped(function: Callable) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Apply to each value; in slices, so that a batch of long texts is never held twice."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [function(v) for at in range(0, len(batch), 64) for v in batch[at : at + 64].to_pylist()]
            yield pa.array(done, pa.binary())

    return run


def encode_ids(text: Column, path: str, pattern: str) -> Column:
    """The ids of each whole text, packed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _mapped(codec(path, pattern).encode)(batches)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(F.coalesce(text, F.lit("")))


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of packed ids; null counts as no ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _mapped(codec(path, pattern).decode)(batches)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(F.coalesce(ids, F.lit(b"")))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
