"""Fingerprints of texts, edits and neighbours against a plain version that shares only the hash of a k-mer."""

from __future__ import annotations

import random
import struct
from base64 import b64decode

import numpy as np

from inkwell.llm import syncmers
from tests.llm import brute

K, S = 16, 8


def codes(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def value(text):
    """The hash of one short run of characters, as the module's windows give it."""
    return int(syncmers._windows(codes(text), len(text))[0])


def anchors(text):
    """{hash: first position} of the closed syncmers, one k-mer at a time."""
    if not text:
        return {}
    if len(text) < K:
        return {value(text): 0}
    kmers = [(i, [value(text[j : j + S]) for j in range(i, i + K - S + 1)]) for i in range(len(text) - K + 1)]
    closed = [(i, m) for i, m in kmers if min(m) in (m[0], m[-1])]
    if not closed:
        closed = [min(kmers, key=lambda x: (min(x[1]), x[0]))]
    out = {}
    for i, m in closed:
        with np.errstate(over="ignore"):
            h = int(syncmers._mix(np.array([m[0]], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([m[-1]], np.uint64))[0])
        out.setdefault(h, i)
    return out


def read(fp):
    n, _, body = fp.partition(":")
    rows = list(struct.iter_unpack("<QI", b64decode(body)))
    assert len(rows) == int(n)
    return dict(rows)


def likeness(a, b, drift=64):
    if a == b:
        return 1.0
    both = a.keys() & b.keys()
    steps = [(b[h] - a[h]) // drift for h in both]
    most = max((sum(s in (d, d - 1) for s in steps) for d in {x for s in steps for x in (s, s + 1)}), default=0)
    return most / len(a.keys() | b.keys()) if a and b else 0.0


def test_against_brute_force(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "de", "ε", "漢字", "\n", "x" * 20, "1 2 3", ""]
    texts = [None, "", "a", "short text", "a" * 15, "a" * 16, "ab" * 40, "😀" * 30] + [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(25)]
    texts += [texts[-1], texts[-2] + " more", texts[-3][5:], "new front " + texts[-4]]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t, "en", "s", 1) for i, t in enumerate(texts)]
    ordered = [(r[0], r[1] or "") for r in sorted(rows, reverse=True)]
    got = {r["doc_id"]: r for r in syncmers.compare_edits(syncmers.in_order(brute.documents(spark, rows), buckets=4)).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = anchors(text), anchors(edited), anchors(following)
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == brute.digest(edited)
        assert read(r["fingerprint"]) == own and read(r["edited_fingerprint"]) == changed
        assert abs(r["near_edited"] - likeness(own, changed)) < 1e-12 and abs(r["near_next"] - likeness(own, after)) < 1e-12
