"""Long lists, which are compared in blocks inside tasks, and hot keys, which are counted by partial sums."""

from __future__ import annotations

import random

import pytest

from inkwell.llm import setjoin
from tests.llm import brute
from tests.llm.test_operators import by_row, near_rows, want


def shared_passage():
    """Rows of a common passage and a few own words: close to each other, linked only in part, so lists stay mixed."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    return [(50_000 + i, " ".join(passage + [f"own{rng.randrange(12)}x{k}" for k in range(rng.choice([2, 5, 7, 9, 14]))]), "en", "s", 1) for i in range(90)]


@pytest.mark.parametrize("partitions", [3, 7])
def test_long_lists_and_hot_keys(spark, partitions, monkeypatch):
    for name, value in {"SHORT": 1, "SIDE": 16, "LEAST_HOT": 3, "HOT": 1 << 30}.items():
        monkeypatch.setattr(setjoin, name, value)
    monkeypatch.setattr(setjoin, "boundary", lambda percent=85, most=64: 0)
    rows = near_rows() + shared_passage()
    members, links = setjoin.classify(brute.documents(spark, rows).repartition(partitions))
    expected = brute.near([r[:2] for r in rows])
    assert by_row(members, "doc_id", "n_shingles", "component_id") == want((r[0], *x) for r, x in zip(rows, expected, strict=True))

    # Every link returned is one, and together they span the components.
    class_of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {class_of[r[0]]: brute.shingles(r[1]) for r in rows}
    parent = {c: c for c in sets}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in {(r["a"], r["b"]) for r in links.collect()}:
        assert 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
        parent[find(a)] = find(b)
    component = {r[0]: c for r, (_, c) in zip(rows, expected, strict=True)}
    by_root: dict = {}
    for doc_id, c in class_of.items():
        by_root.setdefault(find(c), set()).add(component[doc_id])
    assert all(len(v) == 1 for v in by_root.values()) and len(by_root) == len(set(component.values()))
