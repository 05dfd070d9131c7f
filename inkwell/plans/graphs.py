"""Queries of the graph operators (I, J6-J10) and of graph storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import graph as G
from inkwell.operators import store
from inkwell.plans.registry import query
from inkwell.sources.entities import AS_OF_YEAR, ctes, entity, table

GR = ctes("nodes", "cites")


def _graph(spark, sf):
    return entity(spark, sf, "nodes"), entity(spark, sf, "cites")


def _starts(nodes, test):
    return nodes.where(test).select("node_id")


_STEPS = {"out": "select source_id u, target_id v from cites where edge_type = 'cites'", "in": "select target_id u, source_id v from cites where edge_type = 'cites'"}
_STEPS["both"] = _STEPS["out"] + " union " + _STEPS["in"]


def _layers(direction: str, starts: str, depth: int) -> str:
    """Distances by a bounded recursion."""
    return f""", st as materialized (select distinct * from ({_STEPS[direction]})), seeds as (select node_id s from nodes where {starts}),
    w as (select s, s x, 0 h from seeds union select w.s, st.v, w.h + 1 from w join st on st.u = w.x where w.h < {depth}), dist as (select s, x, min(h) h from w group by s, x)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query("g1_traverse", _recursive(GR + _layers("out", "node_id % 50 = 49", 3) + " select s as start, x as node_id, h::int as hops from dist where h > 0 and x in (select node_id from nodes)"))
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.traverse(nodes, edges, _starts(nodes, "node_id % 50 = 49"), 3)


@query("g1_traverse_both", _recursive(GR + _layers("both", "node_id % 50 = 0", 2) + " select s as start, x as node_id, h::int as hops from dist where h > 0 and x in (select node_id from nodes)"))
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.traverse(nodes, edges, _starts(nodes, "node_id % 50 = 0"), 2, "both")


@query(
    "g2_shortest_path",
    _recursive(GR + """, st as materialized (select source_id u, target_id v from cites union select target_id, source_id from cites), goals(s, g) as (select node_id, node_id + (node_id % 100) // 50 from nodes where node_id % 50 = 0),
    w as (select s, s x, 0 h from goals union select w.s, st.v, w.h + 1 from w join st on st.u = w.x where w.h < 6) select s as start, g as goal, min(h)::int as hops from w join goals using (s) where x = g group by s, g"""),
)
def _(spark, sf):
    # Each pair is a node and the next one, or the node itself.
    pairs = entity(spark, sf, "nodes").where(_SEEDS).select(F.col("node_id").alias("start"), (F.col("node_id") + F.expr("node_id % 100 div 50")).alias("goal"))
    return G.shortest_path(entity(spark, sf, "cites"), pairs, 6).select("start", "goal", "hops")


def _pagerank_sql(iterations: int) -> str:
    out = GR + """, n as (select count(*)::double n from nodes), l as materialized (select source_id u, target_id v, count(*) k from cites where edge_type = 'cites' and source_id in (select node_id from nodes) and target_id in (select node_id from nodes) group by 1, 2),
    d as materialized (select u, v, k::double / sum(k) over (partition by u) w from l), r0 as (select node_id, 1 / n r from nodes, n)"""
    for i in range(iterations):
        out += f", r{i + 1} as materialized (select nodes.node_id, 0.15 / n + 0.85 * coalesce(s, 0) r from nodes join n on true left join (select v, sum(w * r) s from d join r{i} on r{i}.node_id = d.u group by v) x on x.v = nodes.node_id)"
    return out + f" select node_id, round(r, 8) as pagerank from r{iterations}"


@query("g3_pagerank", _pagerank_sql(20))
def _(spark, sf):
    return G.pagerank(*_graph(spark, sf)).withColumn("pagerank", F.round("pagerank", 8))


def _hits_sql(iterations: int) -> str:
    out = GR + ", l as materialized (select source_id u, target_id v from cites where edge_type = 'cites' and source_id in (select node_id from nodes) and target_id in (select node_id from nodes)), h0 as (select node_id, 1.0::double h from nodes)"
    for i in range(iterations):
        out += f""", a{i} as materialized (select v node_id, sum(h) a from l join h{i} on h{i}.node_id = l.u group by v), b{i} as materialized (select u node_id, sum(a) h from l join a{i} on a{i}.node_id = l.v group by u),
        x{i} as materialized (select sqrt(sum(a * a)) x from a{i}), y{i} as materialized (select sqrt(sum(h * h)) y from b{i}),
        h{i + 1} as materialized (select nodes.node_id, coalesce(b.h, 0) / y h, coalesce(a.a, 0) / x a from nodes join x{i} on true join y{i} on true left join a{i} a on a.node_id = nodes.node_id left join b{i} b on b.node_id = nodes.node_id)"""
    return out + f" select node_id, round(h, 6) as hub, round(a, 6) as authority from h{iterations}"


@query("g4_hits", _hits_sql(6))
def _(spark, sf):
    return G.hits(*_graph(spark, sf), iterations=6).select("node_id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query("g5_citation_velocity", ctes("papers") + " select paper_id, round(case when coalesce(year(publication_date), papers.year) is null then 0 else citation_count / greatest(1, 2024 - coalesce(year(publication_date), papers.year)) end, 6)::double as velocity from papers".replace("year(publication_date)", "date_part('year', publication_date)"))
def _(spark, sf):
    from inkwell.functions.scores import citation_velocity

    return entity(spark, sf, "papers").select("paper_id", F.round(citation_velocity(F.col("citation_count"), F.col("publication_date"), F.col("year"), AS_OF_YEAR), 6).alias("velocity"))


@query("g6_influence_metrics", _pagerank_sql(4).rsplit(" select node_id, round", 1)[0] + " select node_id, citation_count, round(citation_count / greatest(1, 2024 - nodes.year), 6)::double as velocity, round(r, 8) as pagerank from nodes join r4 using (node_id)")
def _(spark, sf):
    m = G.influence(*_graph(spark, sf), AS_OF_YEAR, iterations=4, hits_iterations=2)
    return m.select("node_id", "citation_count", F.round("velocity", 6).alias("velocity"), F.round("pagerank", 8).alias("pagerank"))


_SEEDS = "node_id % 50 = 0"
_REFS = ", refs as materialized (select distinct source_id, target_id from cites where edge_type = 'cites'), z as (select source_id, count(*) n from refs group by 1)"


@query(
    "g7_recommend_similar",
    _recursive(GR + _layers("both", _SEEDS, 2) + _REFS + """, p as (select s, x from dist where h > 0 and x in (select node_id from nodes)),
    c as (select p.s, p.x, count(*) k from p join refs a on a.source_id = p.s join refs b on b.source_id = p.x and a.target_id = b.target_id group by 1, 2),
    q as (select c.s, c.x, k::double / (a.n + b.n - k) score from c join z a on a.source_id = c.s join z b on b.source_id = c.x)
    select s as seed, x as node_id, round(score, 6) as score from q qualify row_number() over (partition by s order by score desc, x) <= 5"""),
)
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.recommend_similar(nodes, edges, _starts(nodes, _SEEDS), 5).withColumn("score", F.round("score", 6))


@query(
    "g8_recommend_predecessors",
    _recursive(_pagerank_sql(5).rsplit(" select node_id, round", 1)[0] + _layers("out", _SEEDS, 2) + """, q as (select s, x, round(r, 10) r from dist join r5 on r5.node_id = x where h > 0)
    select s as seed, x as node_id, round(r / max(r) over (partition by s), 6) as score from q qualify row_number() over (partition by s order by r desc, x) <= 5"""),
)
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    ranks = G.pagerank(nodes, edges, iterations=5).withColumn("pagerank", F.round("pagerank", 10))
    return G.recommend_predecessors(nodes, edges, _starts(nodes, _SEEDS), ranks, 5).withColumn("score", F.round("score", 6))


@query(
    "g9_recommend_successors",
    _recursive(GR + _layers("in", _SEEDS, 2) + """, q as (select s, x, citation_count / greatest(1, 2024 - nodes.year) v from dist join nodes on node_id = x where h > 0 and nodes.year >= 2022)
    select s as seed, x as node_id, round(case when max(v) over (partition by s) > 0 then v / max(v) over (partition by s) else 0 end, 6)::double as score from q qualify row_number() over (partition by s order by v desc, x) <= 5"""),
)
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.recommend_successors(nodes, edges, _starts(nodes, _SEEDS), AS_OF_YEAR, 5).withColumn("score", F.round("score", 6))


@query(
    "g10_recommend_bridges",
    _recursive(GR + _layers("both", _SEEDS, 3) + _REFS + """, q as (select d.s, target_id x, count(*) n from dist d join refs on source_id = d.x join dist e on e.s = d.s and e.x = target_id and e.h between 1 and 2 where d.h = 3 and target_id in (select node_id from nodes) group by 1, 2 having count(*) >= 2)
    select s as seed, x as node_id, round(n::double / max(n) over (partition by s), 6) as score from q qualify row_number() over (partition by s order by n desc, x) <= 5"""),
)
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.recommend_bridges(nodes, edges, _starts(nodes, _SEEDS), 5).withColumn("score", F.round("score", 6))


@query(
    "g11_crawl",
    _recursive(GR + f""", o as (select u, v from (select distinct * from ({_STEPS['out']})) t join nodes on node_id = v qualify row_number() over (partition by u order by citation_count desc, v) <= 3),
    i as (select u, v from (select distinct * from ({_STEPS['in']})) t join nodes on node_id = v qualify row_number() over (partition by u order by citation_count desc, v) <= 3),
    st as materialized (select * from o union select * from i), w as (select node_id s, node_id x, 0 h from nodes where {_SEEDS} union select w.s, st.v, h + 1 from w join st on st.u = w.x where h < 2)
    select s as start, x as node_id, min(h)::int as hops from w group by s, x"""),
)
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.crawl(nodes, edges, _starts(nodes, _SEEDS), 2, 3, [F.col("citation_count").desc()])


@query("a5_citer_counts", ctes("cites") + " select target_id as node_id, count(*) as citers from cites where edge_type = 'cites' group by 1")
def _(spark, sf):
    return G.citer_counts(entity(spark, sf, "cites"))


@query("a4_graph_counts", GR + " select 'node' as what, node_type as kind, count(*) as n from nodes group by 2 union all select 'edge', edge_type, count(*) from cites group by 2")
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    count = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).alias("kind")).agg(F.count("*").alias("n"))
    return count(nodes, "node", "node_type").union(count(edges, "edge", "edge_type"))


@query("a25_graph_size_level", GR + " select count(*) as n, case when count(*) >= 100000 then 'migrate' when count(*) >= 75000 then 'warn' else 'ok' end as level from nodes")
def _(spark, sf):
    n = F.count("*")
    return entity(spark, sf, "nodes").agg(n.alias("n"), F.when(n >= 100_000, "migrate").when(n >= 75_000, "warn").otherwise("ok").alias("level"))


@query("j6_co_citations", GR + ", p as (select node_id a, node_id + 1 b from nodes), c as (select distinct source_id, target_id from cites where edge_type = 'cites') select a, b, (select count(*) from c x join c y on x.source_id = y.source_id where x.target_id = a and y.target_id = b and x.source_id not in (a, b)) as co_citations from p")
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.co_citations(edges, nodes.select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b")))


@query("g14_co_citation_guard", GR + ", n as (select target_id t, count(*) n from cites where edge_type = 'cites' group by 1), c as (select distinct source_id, target_id from cites where edge_type = 'cites') select node_id as a, node_id + 1 as b, case when coalesce(p.n, 0) > 3 or coalesce(q.n, 0) > 3 then 0 else (select count(*) from c x join c y on x.source_id = y.source_id where x.target_id = node_id and y.target_id = node_id + 1 and x.source_id not in (node_id, node_id + 1)) end as co_citations from nodes left join n p on p.t = node_id left join n q on q.t = node_id + 1")
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.co_citations(edges, nodes.select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b")), 3)


@query("j7_coupling_pairs", ctes("refs") + ", p as (select o_orderkey a, o_orderkey + 1 b from orders), z as (select source_id, count(*) n from refs group by 1), s as (select p.a, p.b, count(*) k from p join refs x on x.source_id = p.a join refs y on y.source_id = p.b and x.target_id = y.target_id group by 1, 2) select p.a, p.b, coalesce(k, 0) as shared, round(case when coalesce(u.n, 0) + coalesce(v.n, 0) > 0 then coalesce(k, 0)::double / (coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(k, 0)) else 0 end, 6) as strength from p left join s on s.a = p.a and s.b = p.b left join z u on u.source_id = p.a left join z v on v.source_id = p.b")
def _(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return G.coupling(entity(spark, sf, "refs"), pairs).select("a", "b", "shared", F.round("strength", 6).alias("strength"))


@query("j8_coupling_top", ctes("refs") + ", z as (select source_id, count(*) n from refs group by 1), s as (select x.source_id seed, y.source_id other, count(*) k from refs x join refs y on x.target_id = y.target_id and x.source_id <> y.source_id where x.source_id % 50 = 0 group by 1, 2), q as (select seed, other, k as shared, k::double / (u.n + v.n - k) strength from s join z u on u.source_id = seed join z v on v.source_id = other) select seed, other, shared, round(strength, 6) as strength from q qualify row_number() over (partition by seed order by strength desc, other) <= 5")
def _(spark, sf):
    refs = entity(spark, sf, "refs")
    seeds = refs.where("source_id % 50 = 0").select(F.col("source_id").alias("seed"))
    return G.coupling_top(refs, seeds, 5).withColumn("strength", F.round("strength", 6))


@query("j9_nodes_by_id", GR + " select node_id, node_type from nodes where node_id in (select custkey from (select o_custkey custkey from orders))")
def _(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("node_id"))
    return entity(spark, sf, "nodes").join(wanted, "node_id", "left_semi").select("node_id", "node_type")


@query("j10_bridge_counts", ctes("refs") + " select target_id, count(*) as n from refs where source_id in (select o_orderkey from orders where o_orderpriority = '1-URGENT') and target_id in (select p_partkey from part where p_size < 20) group by 1 having count(*) >= 2")
def _(spark, sf):
    far = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("source_id"))
    near = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("target_id"))
    return entity(spark, sf, "refs").join(far, "source_id", "left_semi").join(near, "target_id", "left_semi").groupBy("target_id").agg(F.count("*").alias("n")).where("n >= 2")


@query("u1_neighbours", ctes("cites") + " select target_id as node_id from cites where source_id % 50 = 0 union all select source_id from cites where target_id % 50 = 0")
def _(spark, sf):
    e = entity(spark, sf, "cites")
    return e.where("source_id % 50 = 0").select(F.col("target_id").alias("node_id")).unionAll(e.where("target_id % 50 = 0").select("source_id"))


@query("u3_reference_sets", ctes("refs") + ", p as (select o_orderkey a, o_orderkey + 1 b from orders) select a, b, (select count(*) from (select target_id from refs where source_id = a intersect select target_id from refs where source_id = b)) as n_both, (select count(*) from (select target_id from refs where source_id = a union select target_id from refs where source_id = b)) as n_either from p")
def _(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    sets = entity(spark, sf, "refs").groupBy("source_id").agg(F.collect_set("target_id").alias("s"))
    none = F.array().cast("array<bigint>")
    got = pairs.join(sets.toDF("a", "x"), "a", "left").join(sets.toDF("b", "y"), "b", "left").withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    return got.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n_both"), F.size(F.array_union("x", "y")).cast("long").alias("n_either"))


@query("u4_distant_nodes", _recursive(GR + _layers("both", "node_id % 50 = 0", 3) + " select s as start, x as node_id from dist where h = 3"))
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    seeds = _starts(nodes, _SEEDS)
    reach = lambda d: G.distances(edges, seeds, d, "both").select("start", "node_id")
    return reach(3).exceptAll(reach(2))


@query("u6_node_edge_dedup", ctes("cites") + " select source_id, arg_min(edge_id, target_id * 2 + case when edge_id like 'd%' then 1 else 0 end) as first_edge, arg_max(edge_id, target_id * 2 + case when edge_id like 'd%' then 1 else 0 end) as last_edge from cites group by 1")
def _(spark, sf):
    e = entity(spark, sf, "cites").withColumn("pos", F.col("target_id") * 2 + F.col("edge_id").startswith("d").cast("int"))
    first = store.first_of(e, ["source_id"], [F.col("pos")]).select("source_id", F.col("edge_id").alias("first_edge"))
    last = store.first_of(e, ["source_id"], [F.col("pos").desc()]).select("source_id", F.col("edge_id").alias("last_edge"))
    return first.join(last, "source_id")


@query("g13_cascade_delete", GR + " select edge_id from cites where source_id % 10 <> 3 and target_id % 10 <> 3")
def _(spark, sf):
    nodes, edges = _graph(spark, sf)
    return store.delete_nodes(nodes, edges, nodes.where("node_id % 10 = 3"))[1].select("edge_id")


@query("k3_update_node", GR + " select node_id, case when node_id % 4 = 0 then 2 else 1 end as version, case when node_id % 4 = 0 then 'xx' else json_extract_string(properties, '$.lang') end as lang from nodes")
def _(spark, sf):
    nodes = entity(spark, sf, "nodes").select("node_id", F.lit(1).alias("version"), F.create_map(F.lit("lang"), F.get_json_object("properties", "$.lang")).alias("properties"))
    updates = nodes.where("node_id % 4 = 0").select("node_id", F.lit(1).alias("expected_version"), F.create_map(F.lit("lang"), F.lit("xx")).alias("new_properties"))
    return store.update_checked(nodes, updates, "node_id").select("node_id", "version", F.col("properties")["lang"].alias("lang"))


@query("k1_bulk_insert", GR + " select count(*) as n from (select node_id from nodes union all select node_id + 10000000 from nodes)")
def _(spark, sf):
    nodes = entity(spark, sf, "nodes").select("node_id")
    return store.checked_insert(nodes, nodes.select((F.col("node_id") + 10_000_000).alias("node_id")), "node_id").agg(F.count("*").alias("n"))


@query("k4_canonical_pairs", GR + " select least(source_id, target_id) as a, greatest(source_id, target_id) as b, max(edge_id) as edge_id from cites group by 1, 2")
def _(spark, sf):
    e = entity(spark, sf, "cites").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "edge_id")
    return e.groupBy("a", "b").agg(F.max("edge_id").alias("edge_id"))
