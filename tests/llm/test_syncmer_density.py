"""Fingerprints keep the anchors of a passage whatever the length of the text around it."""

from __future__ import annotations

import random

from inkwell.llm import syncmers
from tests.llm import brute


def noise(seed, n):
    return "".join(random.Random(seed).choices("abcdefghij klmnop", k=n))


def kept(text):
    return set(syncmers.parse(syncmers.write(syncmers.sketch(text)))[0].tolist())


def test_a_passage_keeps_its_anchors():
    passage = noise(1, 600)
    own = set(syncmers.anchors(passage)[0].tolist())
    texts = [passage, noise(2, 50) + passage, noise(3, 30_000) + passage + noise(4, 30_000), passage + noise(5, 200_000)]
    for t in texts:
        assert own <= kept(t)
    for a in texts:
        for b in texts:
            assert syncmers.likeness(syncmers.sketch(a), syncmers.sketch(b)) > 0


def test_one_density():
    for n in (300, 3_000, 30_000, 300_000):
        assert abs(len(kept(noise(n, n))) / n - 2 / 9) < 0.05


def test_likeness_is_the_count():
    a, b = noise(6, 5_000), noise(7, 700) + noise(6, 5_000)[1_000:4_000]
    x, y = (dict(zip(*(v.tolist() for v in syncmers.sketch(t)), strict=True)) for t in (a, b))
    near = [(y[h] - x[h]) // syncmers.DRIFT for h in x.keys() & y.keys()]
    most = max(sum(n in (s, s - 1) for n in near) for s in {*near, *(n + 1 for n in near)})
    assert syncmers.likeness(syncmers.sketch(a), syncmers.sketch(b)) == most / len(x.keys() | y.keys())


def test_fingerprints_column(spark):
    rows = [(1, noise(8, 20_000), "en", "s", 1), (2, None, "en", "s", 1), (3, "short", "en", "s", 1)]
    got = {r["doc_id"]: r["fingerprint"] for r in syncmers.fingerprints(brute.documents(spark, rows)).collect()}
    assert got == {r[0]: syncmers.write(syncmers.anchors(r[1] or "")) for r in rows} and got[2] == "0:"
