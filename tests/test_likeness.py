"""Likeness of syntax trees: the same ratio as difflib's, in time that long texts allow."""

import random
import time
from difflib import SequenceMatcher

from corpusloom.operators.code_units import likeness

ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz     eeee", "".join(map(chr, range(0x5000, 0x5100))), "etaoin shrdlu vkxqjz,.()=\U0001f600", "abcab c"]


def changed(r, text, letters):
    out = list(text)
    for _ in range(r.randrange(12)):
        x = r.randrange(len(out) + 1)
        y = min(len(out), x + r.randrange(40))
        out[x:y] = r.choice([[], r.choices(letters, k=20), out[x:y] * 2, out[y : y + 20]])
    return "".join(out)


def test_ratio_is_difflibs():
    r = random.Random(5)
    for k in range(200):
        letters = ALPHABETS[k % len(ALPHABETS)]
        a = "".join(r.choices(letters, k=r.choice([0, 1, 3, 50, 199, 200, 201, 400])))
        b = changed(r, a, letters) if k % 2 else "".join(r.choices(letters, k=r.choice([0, 1, 5, 198, 200, 300])))
        assert likeness(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_long_texts_end():
    r = random.Random(6)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkqjxz", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 1, 1, 0.2, 0.2, 0.2, 0.1], k=r.randrange(2, 9))) for _ in range(3000)]
    a, b = (" ".join(r.choices(words, k=30000)) for _ in range(2))
    began = time.perf_counter()
    assert 0 < likeness(a, b) < 1
    assert likeness(a, a[:-1] + "?") > 0.9999
    assert time.perf_counter() - began < 30
