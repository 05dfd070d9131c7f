"""Queries of what is built and kept: graphs from providers, indexes, stored tables and their versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.lineage import scratch
from inkwell.operators import retrieval as R
from inkwell.operators import timeseries
from inkwell.operators.graph_build import Graph, build
from inkwell.plans.registry import query
from inkwell.plans.scores import UNIFIED, unified
from inkwell.sources import mappers, readers, schema_versions, sinks
from inkwell.sources.entities import AS_OF, ctes, entity, table
from inkwell.streaming.incremental import retained

P, GR = ctes("papers"), ctes("nodes", "cites")
_FAR = 1_000_000_000
_ERROR = "case when place = 0 and direction = 'out' and seed % 150 = 0 then 'HTTP 500' when place = 0 and direction = 'in' and seed % 200 = 0 then 'HTTP 404' when place = 1 and seed % 300 = 0 then 'down' end"


@query(
    "g12_graph_build",
    GR + f""", tried as (select node_id as seed, direction, place, provider, node_id + place * {_FAR} as seed_id from nodes, (values ('out'), ('in')) d(direction), (values (0, 's2'), (1, 'openalex')) p(place, provider) where node_id % 50 = 0),
    a as (select *, {_ERROR} as error from tried), ch as (select seed, direction, arg_min(provider, place) provider, arg_min(seed_id, place) seed_id from a where error is null group by 1, 2),
    c as (select distinct source_id, target_id from cites where edge_type = 'cites'), rel as (select source_id seed, 'out' direction, target_id node_id from c union all select target_id, 'in', source_id from c),
    got as (select seed, direction, seed_id, node_id from rel join ch using (seed, direction) qualify row_number() over (partition by seed, direction order by node_id) <= 3),
    f as (select node_id, min(seed) seed from (select seed, seed_id as node_id from ch union all select seed, node_id from got) group by 1),
    nn as (select seed, count(*) n from f where node_id not in (select node_id from nodes where node_id % 2 = 0) group by 1),
    e as (select s, t, min(seed) seed from (select seed, case direction when 'out' then seed_id else node_id end s, case direction when 'out' then node_id else seed_id end t from got) group by 1, 2),
    ne as (select seed, count(*) n from e where not exists (select 1 from c where c.source_id = s and c.target_id = t and s % 4 = 0) group by 1),
    u as (select a.seed, count(distinct ch.provider) k, min(ch.provider) one from a left join ch using (seed, direction) group by 1),
    r as (select seed, string_agg(provider || ': ' || error, '|' order by direction = 'in', place) errors from a where error is not null group by 1)
    select u.seed, case k when 0 then 'none' when 1 then one else 'both' end as provider_used, coalesce(nn.n, 0) as nodes_added, coalesce(ne.n, 0) as edges_added, coalesce(errors, '') as errors from u left join nn using (seed) left join ne using (seed) left join r using (seed)""",
)
def _(spark, sf):
    nodes, cites = entity(spark, sf, "nodes"), entity(spark, sf, "cites").where("edge_type = 'cites'").select("source_id", "target_id").distinct()
    sides = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(i).alias("place"), F.lit(p).alias("provider")) for d in ("out", "in") for i, p in enumerate(("s2", "openalex")))))
    tried = nodes.where("node_id % 50 = 0").select(F.col("node_id").alias("seed"), sides.alias("x")).select("seed", "x.*").withColumn("seed_id", F.col("seed") + F.col("place") * _FAR)
    answers = tried.withColumn("error", F.expr(_ERROR))
    both = cites.select(F.col("source_id").alias("seed"), F.lit("out").alias("direction"), F.col("target_id").alias("node_id")).unionAll(cites.select("target_id", F.lit("in"), "source_id"))
    related = both.select("*", F.explode(F.array(F.lit("s2"), F.lit("openalex"))).alias("provider")).withColumn("place", F.col("node_id"))
    stored = cites.where("source_id % 4 = 0").select(T.edge_key(F.col("source_id").cast("string"), F.col("target_id").cast("string")).alias("edge_id"))
    return build(answers, related, nodes.where("node_id % 2 = 0"), stored, 3)[2].withColumn("errors", F.array_join("errors", "|"))


_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '' and w not in (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))"


@query("r4_index_chunks", f"select term, count(distinct doc_id) as n_chunks, count(*) as n from (select doc_id, unnest({_TOKENS}) term from documents) group by 1")
def _(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    old = chunks.where("id % 3 = 0").withColumn("text", F.when(F.col("id") % 2 == 0, "of old").otherwise(F.col("text")))
    index = R.index_chunks(R.index_chunks(None, old), chunks)
    return index.select("id", F.explode("terms").alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("n_chunks"), F.sum("x.tf").alias("n"))


@query("n19_ensure_fresh", "select doc_id as id, case when doc_id % 3 = 0 then 'changed' else 'new' end as why, doc_id % 3 <> 0 as read_again from documents where doc_id % 3 <> 0 or doc_id % 6 = 0")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))
    ingested = docs.where("id % 3 = 0").withColumn("checksum", F.when(F.col("id") % 6 == 0, "old").otherwise(F.col("checksum")))
    all_stale, known_skipped = R.ensure_fresh(docs, ingested), R.ensure_fresh(docs, ingested, reread=False)
    return all_stale.join(known_skipped.select("id", F.lit(True).alias("read_again")), "id", "left").withColumn("read_again", F.coalesce("read_again", F.lit(False)))


@query("s2_s4_search", P + f" select paper_id, publication_date::varchar as published, citation_count from papers where publication_date between date '2015-01-01' and date '2022-12-31' and citation_count >= 100 order by papers.publication_date desc nulls last, paper_id limit 200")
def _(spark, sf):
    path = f"{scratch(spark)}/feed"
    p = entity(spark, sf, "papers")
    p.select("paper_id", "title", F.col("publication_date").alias("published"), "year", "citation_count").write.json(path)
    return readers.search(spark, path, ("paper_id", "published", "citation_count"), "2015-01-01", "2022-12-31", 100, 200).withColumn("published", F.col("published").cast("string"))


@query("s13_registry_load", P + " select paper_id, topic from papers")
def _(spark, sf):
    path = f"{scratch(spark)}/registry"
    p = entity(spark, sf, "papers")
    entry = F.create_map(F.col("paper_id"), F.struct("paper_id", F.array("topic").alias("topic_affiliations")))
    p.select(F.to_json(F.struct(entry.alias("entries"))).alias("value")).write.text(path)
    return readers.registry(spark, path, whole=False).select("paper_id", F.col("topic_affiliations")[0].alias("topic"))


@query("k5_influence_cache", P + f" select paper_id, case when pos % 2 = 0 then citation_count + 1 else citation_count end as citation_count from papers where pos % 2 = 0 or pos % 3 = 0")
def _(spark, sf):
    p = entity(spark, sf, "papers")
    day = lambda d: F.lit(d).cast("date").alias("computed_at")
    old = p.select("paper_id", "citation_count", F.when(F.col("pos") % 3 == 0, F.lit("2024-01-29").cast("date")).otherwise(F.lit("2023-06-01").cast("date")).alias("computed_at"))
    new = p.where("pos % 2 = 0").select("paper_id", (F.col("citation_count") + 1).alias("citation_count"), day(AS_OF))
    return retained(timeseries.upsert(old, new, ["paper_id"], "computed_at"), AS_OF, 7).select("paper_id", "citation_count")


@query("k7_briefs", P + " select topic as report_id, row_number() over (partition by topic order by pos) as place, 'Paper ' || paper_id as title from papers qualify place <= 3")
def _(spark, sf):
    from inkwell.operators.graph import top_per

    p = top_per(entity(spark, sf, "papers"), ["topic"], [F.col("pos")], 5, "place")
    entries = p.select(F.col("topic").alias("report_id"), "place", F.concat(F.lit("Paper "), "paper_id").alias("title"), F.concat(F.lit("http://host/"), "paper_id").alias("url"), F.lit("Found **much**.").alias("summary"))
    return mappers.key_learnings(sinks.brief(entries), 3).select("report_id", F.col("place").cast("long").alias("place"), "title")


@query("n29_schema_versions", P + " select paper_id, topic, 2 as schema_version, 0 as applied_again from papers")
def _(spark, sf):
    folder = scratch(spark)
    papers = entity(spark, sf, "papers").select("paper_id", "topic")
    steps = [
        schema_versions.Step(1, "papers", lambda s, t: {"papers": papers.select("paper_id")}),
        schema_versions.Step(2, "topics", lambda s, t: {"papers": t["papers"].join(papers, "paper_id")}),
    ]
    schema_versions.migrate(spark, folder, steps[:1])
    schema_versions.migrate(spark, folder, steps)
    again = schema_versions.migrate(spark, folder, steps)
    return sinks.current_table(spark, folder, "papers").select("paper_id", "topic", F.lit(max(schema_versions.applied(spark, folder))).alias("schema_version"), F.lit(again).alias("applied_again"))


@query("x1_x6_graph_store", GR + ", r as (select distinct source_id, target_id from cites where edge_type = 'cites'), p as (select node_id a, node_id + 1 b from nodes where node_id % 10 <> 0), s as (select p.a, p.b, count(*) k from p join r x on x.source_id = p.a join r y on y.source_id = p.b and x.target_id = y.target_id group by 1, 2) select a, b, coalesce(k, 0) as shared from p left join s using (a, b)")
def _(spark, sf):
    nodes, cites = entity(spark, sf, "nodes").select("node_id", "node_type"), entity(spark, sf, "cites")
    graph = Graph(nodes.where("node_id % 2 = 0"), cites.where("source_id % 2 = 0")).add_nodes(nodes.where("node_id % 2 = 1")).add_edges(cites.where("source_id % 2 = 1"))
    pairs = graph.delete(nodes.where("node_id % 10 = 0")).ids().select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"))
    return graph.coupling_of(pairs).select("a", "b", "shared")


_SAID = {"graphs and not trees": ["graphs", "trees"], '"neural nets" OR ab "x y" (deep)': ["neural nets", "x y", "deep"], '"ab" AND Or': [], "Large, Models": ["large", "models"]}


@query("p4_query_terms", "select * from (values " + ", ".join(f"({q!r}, {i}, '{t}')".replace('\\"', '"') for q, ts in _SAID.items() for i, t in enumerate(ts)) + ") v(query, place, term)")
def _(spark, sf):
    rows = [(q, i, t) for q in _SAID for i, t in enumerate(mappers.query_terms(q))]
    return spark.createDataFrame(rows, "query string, place int, term string")


@query("f_str17_author_shapes", """select doc_id, case doc_id % 5 when 0 then 'A' || doc_id::varchar || ';B' when 1 then 'C ' || doc_id::varchar || ';D' when 2 then 'E' || doc_id::varchar when 3 then '' else '{"authorId":"' || doc_id::varchar || '"}' end as names from documents""")
def _(spark, sf):
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    said = (
        F.when(m == 0, F.concat(F.lit('[{"name": "A'), i, F.lit('"}, {"name": "B", "authorId": "1"}]'))).when(m == 1, F.concat(F.lit('["C '), i, F.lit('", "D"]'))).when(m == 2, F.concat(F.lit('"E'), i, F.lit('"')))
        .when(m == 3, F.lit(None)).otherwise(F.concat(F.lit('[{"authorId":"'), i, F.lit('"}]')))
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.author_names_of_json(said), ";").alias("names"))


@query("s14_stored_tables", GR + " select edge_id, source_id::varchar as source_id, edge_type, 1 as version from cites")
def _(spark, sf):
    folder = scratch(spark)
    edges = entity(spark, sf, "cites").select("edge_id", "edge_type", F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"), F.create_map(F.lit("by"), F.lit("test")).alias("properties"), F.lit(1).alias("version"))
    edges.write.parquet(f"{folder}/edges")
    return readers.stored(spark, folder, "edges").select("edge_id", "source_id", "edge_type", "version")


@query("o6_top_papers", P + f" select paper_id, round({UNIFIED}, 6)::double as score from papers order by score desc, pos limit 20")
def _(spark, sf):
    scored = entity(spark, sf, "papers").withColumn("score", F.round(unified(), 6))
    return scored.orderBy(F.col("score").desc(), "pos").limit(20).select("paper_id", "score")
