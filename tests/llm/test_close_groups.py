"""Groups in which most pairs look close and few link."""

from __future__ import annotations

from inkwell.llm import setjoin
from tests.llm import brute
from tests.llm.test_near_stage import components


def test_close_pairs_are_no_rows(spark, monkeypatch):
    """Copies of a passage with 13 own words each are just below 0.80 of each other; bitmaps let a part of the pairs through."""
    passage = [f"p{i}" for i in range(104)]
    rows = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(13)]), "en", "s", 1) for i in range(140)]
    rows += [(200 + i, " ".join(passage[: 103 - i % 2] + [f"o{i}y{k}" for k in range(11 + i % 3)]), "en", "s", 1) for i in range(12)]
    pairs, cut = [], setjoin.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            pairs.append(out)
        return out

    monkeypatch.setattr(setjoin, "cut", counted)
    monkeypatch.setattr(setjoin, "SIDE", 64)
    members, _ = setjoin.classify(brute.documents(spark, rows), percent=80, words=5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in members.collect())
    assert got == sorted(components(rows, 5, 80))
    assert max(p.count() for p in pairs) <= 6 * len(rows)
