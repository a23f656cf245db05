"""The matcher against the standard library's."""

import random
import time
from difflib import SequenceMatcher

import pytest

from inkproof.functions.gestalt import matcher


def plain(a, b):
    return SequenceMatcher(None, a, b).ratio()


def edited(r, text, letters, share):
    out = []
    for letter in text:
        if r.random() < share:
            out.append(r.choice(["", r.choice(letters), letter + r.choice(letters)]))
        else:
            out.append(letter)
    return "".join(out)


@pytest.mark.parametrize("short", [0, 3, 64])
def test_equal_on_random_pairs(short):
    r, ratio = random.Random(5), matcher(short)
    for n in range(34_000):
        letters = "ab" if n % 3 == 0 else "abcdé " if n % 3 == 1 else "abcdefghijklmnopqrstuvwxyz0123𝔘"
        a = "".join(r.choices(letters, k=r.randint(0, 14)))
        b = edited(r, a, letters, 0.3) if n % 2 else "".join(r.choices(letters, k=r.randint(0, 14)))
        assert ratio(a, b) == plain(a, b), (a, b)


@pytest.mark.parametrize("short", [0, 64])
def test_equal_with_popular_letters(short):
    r, ratio = random.Random(6), matcher(short)
    for n in range(400):
        letters = "abc" if n % 4 == 0 else "".join(map(chr, range(97, 97 + r.choice([8, 60, 150, 400]))))
        weights = [1 / (k + 1) for k in range(len(letters))]
        a = "".join(r.choices(letters, weights, k=r.randint(1, 700)))
        b = edited(r, a, letters, r.choice([0.02, 0.3])) if n % 2 else "".join(r.choices(letters, weights, k=r.randint(150, 700)))
        assert ratio(a, b) == plain(a, b), (a, b)


def test_edges():
    ratio = matcher()
    for a, b in [("", ""), ("", "x"), ("x", ""), ("a" * 199, "a" * 199), ("a" * 200, "a" * 200), ("ba" * 100, "a" * 300), ("\0", "\0")]:
        assert ratio(a, b) == plain(a, b)


def test_time_is_linear_in_the_letters_at_a_given_number_of_edits():
    r, ratio = random.Random(7), matcher()
    letters = list(map(chr, range(0x4E00, 0x4E00 + 4000)))  # none of them popular

    def seconds(n):
        a = "".join(r.choices(letters, k=n))
        b = a
        for cut in range(n // 40, n, n // 20):
            b = b[:cut] + r.choice(letters) + b[cut:]
        started = time.perf_counter()
        assert ratio(a, b) > 0.98
        return time.perf_counter() - started

    seconds(2_000)
    assert seconds(80_000) < 20 * max(seconds(10_000), 0.02)  # 8 times the letters; 64 times if it were quadratic
