"""Gestalt (Ratcliff-Obershelp) similarity as Arrow functions.

The ratio is recursive, so it has no built-in expression.  Everything around it
(normalising, splitting, folding) is done by Spark; these functions
only see what is left and run the matcher of ``gestalt`` on it.

All are iterator functions: the memo of already compared pairs lives as long
as the task does.  They reference nothing of this package, so workers need no
copy of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkproof.functions.gestalt import matcher

_MEMO_ENTRIES = 1 << 17
_LETTER_BUCKETS = 64  # letters sharing a bucket only loosen the bound
_FEW_PAIRS = 512  # below this the arrays cost more than they save
_BLOCK_WORDS = 1 << 15  # text words looked at together, which bounds the memory
_ROWS = 256  # rows of a batch that are Python objects at a time, however many a batch has
_INDEX_FROM = 128  # words sought from which listing the text's words by letters pays


def gestalt_ratio(a: Column, b: Column) -> Column:
    """Ratio of two texts, in that order; null in gives null out."""
    matched = matcher()

    def ratio_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ratio = lru_cache(_MEMO_ENTRIES)(matched)
        for left, right in batches:
            pairs = zip(left.to_pylist(), right.to_pylist())
            yield pa.array(
                [None if x is None or y is None else ratio(x, y) for x, y in pairs], pa.float64()
            )

    return F.arrow_udf(ratio_batches, T.DoubleType())(a, b)


def best_ratios(
    threshold: float, prune: bool = True, index_from: int = _INDEX_FROM
) -> Callable[[], Callable[[Sequence[str], Sequence[str]], list[float]]]:
    """A factory, to be called once per task, of the function (words, others) -> best ratio of each word against the others.

    Best ratios of ``threshold`` or more are exact, lower ones may be lower still.  Nothing that could reach the threshold is
    passed over: a ratio r of words of a and b letters needs r * (a + b) / 2 letters matched in order, so at most
    ``lost`` letters of the word and ``gained`` of the other aren't.  An unmatched letter of the word breaks two of its
    letter pairs, one of the other word breaks one.  So any ``lost + 1`` letters of the word hold one, and any
    ``2 * lost + gained + 1`` pairs hold one, that the other word has too.  The index lists the text's words
    by letter and by pair (counting repeats within a word); the rarest ones of a word give its candidates, which two more
    bounds, of the lengths and of the letters shared, thin out before the matcher sees them.  Fewer words than ``index_from``
    are held against those two bounds alone, as one pass over the text costs less than an index of it.
    """
    buckets, block, few, memo, matched = _LETTER_BUCKETS, _BLOCK_WORDS, _FEW_PAIRS, _MEMO_ENTRIES, matcher()

    def make():
        ratio = lru_cache(memo)(matched)

        def letter_counts(words, lengths):
            letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32) % buckets
            slots = np.repeat(np.arange(len(words)), lengths) * buckets + letters
            counts = np.bincount(slots, minlength=len(words) * buckets)
            return counts.reshape(-1, buckets).astype(np.int32)

        @lru_cache(memo)
        def letter_mask(word):
            mask = 0
            for letter in word:
                mask |= 1 << ord(letter) % buckets
            return mask

        @lru_cache(memo)
        def fitting(size):
            """Lengths of words that may reach the threshold; no tighter than the bound below."""
            if threshold <= 0:
                return 0, float("inf")
            return size * threshold / (2 - threshold) - 1e-6, size * (2 - threshold) / threshold + 1e-6

        def best_of_few(word, others):
            top, mine = 0.0, letter_mask(word)
            low, high = fitting(len(word))
            for other in [o for o in others if low <= len(o) <= high]:
                theirs = letter_mask(other)
                shared = min(
                    len(word) - (mine & ~theirs).bit_count(),
                    len(other) - (theirs & ~mine).bit_count(),
                )
                bound = 2.0 * shared / (len(word) + len(other))
                if bound >= threshold and bound > top:
                    top = max(top, ratio(word, other))
            return top

        def grams(words, lengths, size):
            """Codes of the words' letters (size 1) or pairs (size 2), numbered within a word, and their words."""
            letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            owners = np.repeat(np.arange(len(words)), lengths)
            if size == 2:
                inside = owners[:-1] == owners[1:]
                letters = (letters[:-1] << 21 | letters[1:])[inside]
                owners = owners[:-1][inside]
            order = np.lexsort((letters, owners))
            letters, owners = letters[order], owners[order]
            starts = np.ones(len(letters), dtype=bool)
            starts[1:] = (letters[1:] != letters[:-1]) | (owners[1:] != owners[:-1])
            places = np.arange(len(letters))
            repeat = places - np.maximum.accumulate(np.where(starts, places, 0))
            # a word of more equal letters than there are numbers would only share the last one, which hides nothing it needs
            return letters << 20 | np.minimum(repeat, (1 << 20) - 1), owners

        def listed(words, lengths, size):
            codes, owners = grams(words, lengths, size)
            order = np.argsort(codes, kind="stable")
            return codes[order], owners[order]

        def rarest(index, codes, many):
            """What the index lists under the ``many`` rarest codes, and how much; None if the word has fewer."""
            if many > len(codes):
                return None
            starts, ends = np.searchsorted(index[0], codes), np.searchsorted(index[0], codes, "right")
            chosen = np.argsort(ends - starts, kind="stable")[:many]
            return int((ends - starts)[chosen].sum()), [index[1][starts[c] : ends[c]] for c in chosen]

        def candidates(word, lengths, indexes):
            """Places (among words ordered by length) that may reach the threshold by their length, letters and pairs."""
            if threshold <= 0:
                return slice(0, len(lengths))
            size = len(word)
            # 2 * min / (a + b) must be able to reach it
            low = np.searchsorted(lengths, size * threshold / (2 - threshold) - 1e-6)
            high = np.searchsorted(lengths, size * (2 - threshold) / threshold + 1e-6, "right")
            if low == high or not indexes:
                return slice(low, high)
            sizes = np.unique(lengths[low:high])
            needed = np.ceil(threshold * (size + sizes) / 2 - 1e-6).astype(int)
            lost, gained = np.maximum(size - needed, 0), np.maximum(sizes - needed, 0)
            ways = [
                rarest(index, grams([word], [size], n + 1)[0], int(many.max()))
                for n, (index, many) in enumerate(zip(indexes, (lost + 1, 2 * lost + gained + 1)))
            ]
            _, lists = min((way for way in ways if way), key=lambda way: way[0], default=(0, None))
            if lists is None:
                return slice(low, high)
            places = np.unique(np.concatenate(lists))
            return places[(places >= low) & (places < high)]

        def best_of(words, others):
            if not prune:
                return [max((ratio(w, o) for o in others), default=0.0) for w in words]
            if len(words) * len(others) <= few:
                return [best_of_few(w, others) for w in words]
            top = [0.0] * len(words)
            sizes = np.array([len(w) for w in words])
            mine = letter_counts(words, sizes)
            others = sorted(others, key=len)
            for start in range(0, len(others), block):
                part = others[start : start + block]
                lengths = np.array([len(o) for o in part])
                theirs = letter_counts(part, lengths)
                indexes = [listed(part, lengths, size) for size in (1, 2)] if len(words) >= index_from else None
                for i, word in enumerate(words):
                    places = candidates(word, lengths, indexes)
                    shared = np.minimum(theirs[places], mine[i]).sum(axis=1)
                    bounds = 2.0 * shared / (lengths[places] + sizes[i])
                    hopeful = np.flatnonzero((bounds >= threshold) & (bounds > top[i]))
                    for j in hopeful[np.argsort(-bounds[hopeful], kind="stable")]:
                        if bounds[j] <= top[i]:
                            break
                        top[i] = max(top[i], ratio(word, part[places.start + j if isinstance(places, slice) else places[j]]))
            return top

        return best_of

    return make


def row_lists() -> Callable[[pa.Array], Iterator[tuple[list, ...]]]:
    """The function arrays of lists -> their rows as Python lists (null as None), some rows at a time.

    Lists of words are made from whole arrays of words, which takes a fraction of the time of one scalar after the other.
    """
    rows = _ROWS

    def listed(array):
        # the offsets of no lists at all may be unset memory
        if not len(array):
            return []
        offsets = array.offsets.to_pylist()
        inner = array.values.slice(offsets[0], offsets[-1] - offsets[0])
        flat = listed(inner) if pa.types.is_list(inner.type) else inner.to_numpy(zero_copy_only=False).tolist()
        start = offsets[0]
        known = array.is_valid().to_pylist()
        return [flat[a - start : b - start] if v else None for a, b, v in zip(offsets, offsets[1:], known)]

    def parts(*arrays):
        for start in range(0, len(arrays[0]), rows):
            yield list(zip(*(listed(array.slice(start, rows)) for array in arrays)))

    return parts


def judge_values(
    values: Column, text_words: Column, threshold: float, prune: bool = True
) -> Column:
    """Verdict struct<found, raw> of each value (its words) against the words of its own row's text.

    The result has the places of ``values``: null for null, so nothing has to be looked up
    by key afterwards.  A word that occurs in the text counts 1, any other its best ratio if that reaches
    the threshold (``best_ratios``).  ``prune=False`` compares every pair, for tests.

    Declared non-deterministic, which it is not, as a barrier: otherwise any
    filter on a score is pushed below it, with the whole scoring inlined.
    """
    make, parts_of = best_ratios(threshold, prune), row_lists()
    verdict_type = pa.list_(pa.struct([("found", pa.bool_()), ("raw", pa.float64())]))

    def judge_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        best_of = make()

        def verdict(value, best):
            if not value:
                return {"found": True, "raw": 1.0}
            hits, total = 0, 0.0
            for word in value:
                score = best.get(word, 1.0)
                if score >= threshold:
                    hits += 1
                    total += score
            return {"found": hits == len(value), "raw": total / len(value) if hits else 0.0}

        def judged(values, others):
            if values is None:
                return None
            known = set(others)
            unresolved = list(dict.fromkeys(w for v in values if v is not None for w in v if w not in known))
            best = dict(zip(unresolved, best_of(unresolved, others))) if unresolved else {}
            return [None if v is None else verdict(v, best) for v in values]

        for values_batch, words_batch in batches:
            done = [pa.array([], verdict_type)]
            for part in parts_of(values_batch, words_batch):
                done.append(pa.array([judged(values, others) for values, others in part], verdict_type))
            yield pa.concat_arrays(done)

    judge_udf = F.arrow_udf(judge_batches, "array<struct<found:boolean,raw:double>>").asNondeterministic()
    return judge_udf(values, text_words)
