"""Title comparisons where titles are long, against difflib."""

from __future__ import annotations

import difflib
import random

import pandas as pd

from inkwell.operators import identity as I


def long_titles(n, seed):
    rng = random.Random(seed)
    parts = ["th", "er", "in", "on", "an", "ed", "ou", "ing", "tion", "ble", "en", "es", "whst", "and"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.choice((6, 30, 90)))) for _ in range(n)]


def test_unlike_titles_need_no_alignment(monkeypatch):
    """Titles of all lengths, copies with edits about the threshold among them: the same found, few pairs aligned."""
    rng = random.Random(5)
    right = long_titles(120, 1)
    edited = []
    for t in right[:60]:
        c = list(t)
        for _ in range(int(len(c) * rng.choice((0.03, 0.06, 0.1, 0.14)))):
            c[rng.randrange(len(c))] = rng.choice("etaoqz")
        edited.append("".join(c))
    left = long_titles(120, 2) + edited + [t[: int(len(t) * 0.86)] for t in right[60:]] + ["日本語の題名です", "ab", "a"]
    right += ["日本語の題名でしす", "ab c", "a"]
    aligned = []
    common = I._common
    monkeypatch.setattr(I, "_common", lambda masks, n, b: aligned.append(n) or common(masks, n, b))
    got = I._reaching(0.9)(pd.DataFrame({"k": left}), pd.DataFrame({"q": right}))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert sorted(got["k"]) == sorted(k for k in left if any(ratio(k, q) >= 0.9 for q in right))
    assert len(aligned) < 2 * len(left)


def test_equals_difflib_about_the_limits(monkeypatch):
    """Titles about the length from which difflib leaves out frequent characters, edits about the threshold, low alphabets and astral characters; several stripes and parts of a block."""
    monkeypatch.setattr(I, "STRIPE", 16)
    monkeypatch.setattr(I, "UNPACKED", 1 << 14)
    rng = random.Random(7)
    right = [t[: rng.choice((40, 150, 195, 199, 200, 205, 240))] for t in long_titles(60, 3)] + ["ab" * n for n in (1, 20, 99, 100, 130)] + ["\U00020000" * 30, "x"]
    left = []
    for t in right:
        for share in (0.02, 0.05, 0.09, 0.12):
            c = list(t)
            for _ in range(int(len(c) * share) + 1):
                i = rng.randrange(len(c))
                c[i : i + rng.choice((0, 1))] = rng.choice(("", "e", "q", "\U00020001"))
            left.append("".join(c))
    left = sorted({t for t in left if t})
    got = I._reaching(0.9)(pd.DataFrame({"k": left}), pd.DataFrame({"q": right}))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = [k for k in left if any(ratio(k, q) >= 0.9 for q in right)]
    assert sorted(got["k"]) == sorted(want) and 50 < len(want) < len(left) - 50


def test_unlike_titles_below_the_limit_need_no_alignment(monkeypatch):
    """Many titles of one length, below that from which gaps are few: trigrams rule out what counts of characters and bigrams leave."""
    rng = random.Random(9)
    parts = "th er on an re he in ed nd ha at en es wh or nt ea ti sh ing tion ou ble ly".split()
    word = lambda: rng.choice(("the", "of", *("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(6))))
    titles = [" ".join(word() for _ in range(90))[:190] for _ in range(600)]
    aligned = []
    common = I._common
    monkeypatch.setattr(I, "_common", lambda masks, n, b: aligned.append(n) or common(masks, n, b))
    assert not len(I._reaching(0.9)(pd.DataFrame({"k": titles[::2]}), pd.DataFrame({"q": titles[1::2]})))
    assert len(aligned) < 4500  # of 90,000 pairs; 12,240 without trigrams
