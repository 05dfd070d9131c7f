"""All links of distinct classes against brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.llm import setjoin
from tests.llm import brute
from tests.llm.test_operators import near_rows


@pytest.mark.parametrize("light", [None, 0])
def test_every_link(spark, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda percent=85, most=64: light)
    rows = near_rows()
    members, links = setjoin.classify(brute.documents(spark, rows), every=True)
    class_of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {class_of[r[0]]: brute.shingles(r[1]) for r in rows}
    names = sorted(sets)
    expected = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in links.select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    counts = {r["gid"]: r["n_links"] for r in setjoin.link_counts(links).collect()}
    assert counts == {g: n for g in names if (n := sum(g in p for p in expected))}


def test_pairs_of_blocks(spark):
    side = lambda ids: spark.createDataFrame([(k, i) for k in (1, 2) for i in ids], "key long, gid long").withColumn("gid", F.col("gid") + F.col("key") * 100)
    got = sorted(tuple(r) for r in setjoin._paired(side(range(20)), side(range(10, 35)), ["key"], size=4).collect())
    assert got == sorted((100 * k + i, 100 * k + j) for k in (1, 2) for i in range(20) for j in range(10, 35) if i != j)
