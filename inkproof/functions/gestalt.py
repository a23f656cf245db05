"""Gestalt (Ratcliff-Obershelp) matching of two texts.

The longest common run of a window is taken (of several the one that is first in ``a``, then in ``b``), then the windows left and
right of it are matched in the same way.  Letters that make up over a hundredth of a ``b`` of 200 letters or more never
start a run; they only lengthen one at its sides (or at the start of a window without a run).

Runs are found in one pass over the window: short windows by rows of bits, long ones by a suffix automaton of ``b``.  So the time
is linear in the window for a given alphabet, and in the texts times the depth of the windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

_SHORT = 64  # letters of b up to which rows of bits are quicker than an automaton
_POPULAR_FROM, _POPULAR_SHARE = 200, 100


def matcher(short: int = _SHORT) -> Callable[[str, str], float]:
    """The function (a, b) -> ratio, from 0 to 1; two empty texts have 1.

    What it returns refers to nothing of this package, so it can be sent to workers by value.
    """
    popular_from, share = _POPULAR_FROM, _POPULAR_SHARE

    def letter_places(b, blo, bhi, popular):
        places = {}
        for place in range(blo, bhi):
            letter = b[place]
            if letter not in popular:
                places[letter] = places.get(letter, 0) | 1 << place - blo
        return places

    def run_by_bits(a, alo, ahi, places, shift, width):
        """Bit j of the row of i: a run of the present size ends at a[i] and at place j of the window."""
        mask = (1 << width) - 1
        ones = {}
        for i in range(alo, ahi):
            bits = places.get(a[i], 0) >> shift & mask
            if bits:
                ones[i] = bits
        if not ones:
            return alo, 0, 0
        rows, size = ones, 1
        while True:
            longer = {}
            for i, bits in rows.items():
                bits = bits << 1 & ones.get(i + 1, 0)
                if bits:
                    longer[i + 1] = bits
            if not longer:
                break
            rows, size = longer, size + 1
        i, bits = next(iter(rows.items()))
        return i - size + 1, (bits & -bits).bit_length() - size, size

    def automaton(b, blo, bhi, popular):
        """Steps, links, lengths and first ends of the runs of b's window that hold no popular letter."""
        steps, links, lengths, ends = [{}], [-1], [0], [0]
        last = 0
        for j in range(blo, bhi):
            letter = b[j]
            if letter in popular:
                last = 0
                continue
            state, before = None, last
            if letter not in steps[last]:
                state = len(steps)
                steps.append({})
                links.append(0)
                lengths.append(lengths[last] + 1)
                ends.append(j)
                while before >= 0 and letter not in steps[before]:
                    steps[before][letter] = state
                    before = links[before]
            if before >= 0:
                target = steps[before][letter]
                if lengths[target] != lengths[before] + 1:
                    split = len(steps)
                    steps.append(dict(steps[target]))
                    links.append(links[target])
                    lengths.append(lengths[before] + 1)
                    ends.append(ends[target])
                    links[target] = split
                    while before >= 0 and steps[before].get(letter) == target:
                        steps[before][letter] = split
                        before = links[before]
                    target = split
                if state is None:
                    state = target
                else:
                    links[state] = target
            last = state
        return steps, links, lengths, ends

    def run_by_automaton(a, alo, ahi, b, blo, bhi, popular):
        steps, links, lengths, ends = automaton(b, blo, bhi, popular)
        state = length = size = 0
        end, other = alo, blo
        for i in range(alo, ahi):
            letter = a[i]
            while state and letter not in steps[state]:
                state = links[state]
                length = lengths[state]
            if letter in steps[state]:
                state = steps[state][letter]
                length += 1
                if length > size:
                    size, end, other = length, i, ends[state]
        return (end - size + 1, other - size + 1, size) if size else (alo, blo, 0)

    def ratio(a, b):
        total = len(a) + len(b)
        if not total:
            return 1.0
        popular = frozenset()
        if len(b) >= popular_from:
            most = len(b) // share + 1
            popular = frozenset(letter for letter, count in Counter(b).items() if count > most)
        whole = letter_places(b, 0, len(b), popular) if len(b) <= short else None
        matched, windows = 0, [(0, len(a), 0, len(b))]
        while windows:
            alo, ahi, blo, bhi = windows.pop()
            if bhi - blo > short:
                i, j, size = run_by_automaton(a, alo, ahi, b, blo, bhi, popular)
            else:
                places = letter_places(b, blo, bhi, popular) if whole is None else whole
                i, j, size = run_by_bits(a, alo, ahi, places, 0 if whole is None else blo, bhi - blo)
                j += blo
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
            if size:
                matched += size
                if i > alo and j > blo:
                    windows.append((alo, i, blo, j))
                if i + size < ahi and j + size < bhi:
                    windows.append((i + size, ahi, j + size, bhi))
        return 2.0 * matched / total

    return ratio
