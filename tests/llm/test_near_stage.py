"""The near-duplicate stage at its own width and threshold, against brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from inkwell.llm import setjoin
from tests.llm import brute
from tests.llm.test_operators import by_row, near_rows, want


def shingles(text, words):
    w = brute.WORD.findall((text or "").translate(brute.LOWER))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def links(rows, words, percent):
    """Pairs of indexes of rows (doc_id, text, ...) that link."""
    sets = [shingles(r[1], words) for r in rows]
    return {(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)}


def components(rows, words, percent):
    """(doc_id, n_shingles, component_id) of each row."""
    at = list(range(len(rows)))
    met = links(rows, words, percent)
    while any(at[a] != at[b] for a, b in met):
        for a, b in met:
            at[a] = at[b] = min(at[a], at[b])
    least = {}
    for r, c in zip(rows, at, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    return [(r[0], len(shingles(r[1], words)), least[c]) for r, c in zip(rows, at, strict=True)]


def between():
    """Pairs (2 i, 2 i + 1) that link at 5 words and 0.80 but not at 4 words and 0.85."""
    rng = random.Random(8)
    rows = []
    for n in (100, 150, 400):
        base = [f"b{n}x{i}" for i in range(n)]
        for size, appended in ((n // 5, True), (n * 6 // 100 if n < 400 else 35, False)):
            own = [f"{w}y{size}{appended}" for w in base]
            new = [f"n{rng.random()}" for _ in range(size)]
            copy = own + new if appended else own[:30] + new + own[30 + size :]
            rows += [(len(rows), " ".join(own), "en", "s", 1), (len(rows) + 1, " ".join(copy), "en", "s", 1)]
    return rows


def test_planted_pairs_are_between():
    rows = between()
    assert not links(rows, 4, 85)
    assert links(rows, 5, 80) == {(i, i + 1) for i in range(0, len(rows), 2)}


def test_stage_drops_looser_copies(spark):
    rows = between()
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, len(rows), 2))


@pytest.mark.parametrize("light", [None, 0, 14])
def test_near_at_five_words(spark, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda percent=80, most=64: light)
    rows = near_rows() + [(10_000 + r[0], *r[1:]) for r in between()]
    members, _ = setjoin.classify(brute.documents(spark, rows), percent=80, words=5)
    assert by_row(members, "doc_id", "n_shingles", "component_id") == want(components(rows, 5, 80))
