"""Queries of sources and composite pipelines (A, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores as S
from inkwell.operators import identity as I
from inkwell.operators import prompts as Q
from inkwell.operators import store

from inkwell.plans.identity import _fold
from inkwell.plans.registry import query
from inkwell.plans.scores import UNIFIED, unified
from inkwell.sources import mappers as M
from inkwell.sources import readers
from inkwell.sources.entities import ctes, entity, table

P = ctes("papers")


def _works(spark, sf):
    p = entity(spark, sf, "papers")
    p = p.join(M.inverted_index(p.select("pos", "abstract"), "pos", "abstract").withColumnRenamed("index", "_index"), "pos", "left")
    return p.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("https://openalex.org/"), "paper_id").alias("id"), F.when(F.col("pos") % 19 != 0, F.col("title")).alias("title"), F.col("year").alias("publication_year"), F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"),
                F.col("citation_count").alias("cited_by_count"), (F.col("pos") % 23 == 0).alias("is_retracted"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("_index").alias("abstract_inverted_index"),
                F.struct(F.col("pdf_available").alias("is_oa")).alias("open_access"),
            )
        ).alias("value")
    )


_WORKS = P + ", w as (select paper_id, title, abstract, papers.year, publication_date, citation_count, doi, pdf_available, pos % 23 = 0 as retracted from papers where pos % 19 <> 0)"


@query("s6_map_works", _WORKS + " select paper_id, title, abstract, w.year, publication_date::varchar as publication_date, citation_count, doi from w")
def _(spark, sf):
    return M.map_works(_works(spark, sf)).select("paper_id", "title", "abstract", "year", F.col("publication_date").cast("string").alias("publication_date"), "citation_count", "doi")


@query("s5_works_filter", _WORKS + " select paper_id from w where citation_count > 300 and not retracted and coalesce(abstract, '') <> '' and pdf_available and publication_date >= date '2016-01-01'")
def _(spark, sf):
    return M.map_works(_works(spark, sf)).where(M.works_filter(300, "2016-01-01", None, True)).select("paper_id")


@query("s7_n9_map_daily", P + " select paper_id, title, upvotes as citation_count, publication_date::varchar as publication_date from papers where title <> ''")
def _(spark, sf):
    p = entity(spark, sf, "papers")
    raw = p.select(F.to_json(F.struct(F.struct(F.col("paper_id").alias("id"), "title", F.col("abstract").alias("summary"), F.concat(F.date_format("publication_date", "yyyy-MM-dd"), F.lit("T08:00:00.000Z")).alias("publishedAt"), "upvotes").alias("paper"))).alias("value"))
    return M.map_daily(raw).select("paper_id", "title", "citation_count", F.col("publication_date").cast("string").alias("publication_date"))


@query("s1_n8_map_atom", P + r" select paper_id, trim(regexp_replace(abstract, '\s*\n\s*', ' ', 'g')) as abstract, year(publication_date)::int as year, pos % 3 = 0 as pdf_available from papers".replace("year(publication_date)", "date_part('year', publication_date)"))
def _(spark, sf):
    p = entity(spark, sf, "papers")
    links = F.when(F.col("pos") % 3 == 0, F.array(F.struct(F.lit("http://x/pdf").alias("href"), F.lit("pdf").alias("title")))).otherwise(F.array(F.struct(F.lit("http://x/abs").alias("href"), F.lit("page").alias("title"))))
    e = p.select(F.concat(F.lit("http://host/abs/"), "paper_id").alias("id"), "title", F.col("abstract").alias("summary"), F.concat(F.date_format("publication_date", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("published"), links.alias("links"))
    return M.map_atom(e).select("paper_id", "abstract", "year", "pdf_available")


@query("s8_source_breakdown", P + " select discovery_source, count(*) as n from papers group by 1")
def _(spark, sf):
    return entity(spark, sf, "papers").groupBy("discovery_source").agg(F.count("*").alias("n"))


@query("s9_s10_references", ctes("cites") + " select edge_id from cites where source_id in (select doc_id from documents where doc_id % 10 = 0)")
def _(spark, sf):
    return readers.references(entity(spark, sf, "cites"), table(spark, sf, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("node_id"))).select("edge_id")


@query("s11_provider_fallback", P + " select paper_id from papers where discovery_source = 'openalex' and citation_count > 500")
def _(spark, sf):
    p = entity(spark, sf, "papers")
    return readers.first_answer(p.where("discovery_source = 'none'"), p.where("discovery_source = 'openalex' and citation_count > 500"), p).select("paper_id")


@query("s18_key_learnings", "select doc_id as report_id, p as place, 'Paper ' || p::varchar as title, 'Found ' || doc_id::varchar || ' things.' as summary from documents, (values (1), (2)) v(p)")
def _(spark, sf):
    i = F.col("doc_id").cast("string")
    part = lambda n: F.concat(F.lit(f"\n## {n}. [Paper {n}](http://x)\nFound **"), i, F.lit("** things.\n"))
    reports = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.concat(F.lit("# Brief\nintro\n"), part(1), part(2), part(3)).alias("text"))
    return M.key_learnings(reports, 2).select("report_id", "place", "title", "summary")


@query("s19_best_backend", "with a as (select l_orderkey doc, l_linenumber place, l_discount * 10 q from lineitem) select doc, coalesce(arg_min(place, place) filter (q >= 0.8), arg_max(place, q * 1000 - place)) as backend from a group by doc")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("backend"), F.col("l_linenumber").alias("place"), (F.col("l_discount") * 10).alias("quality"))
    return readers.best_extraction(a, 0.8).select("doc", "backend")


@query("n2_standard_discovery", P + f", u as (select *, case when doi is null then paper_id else doi end i from papers where discovery_source in ('arxiv', 'openalex')), f as (select min(pos) pos from u group by i), s as (select paper_id, pos, round({UNIFIED}, 6)::double score from u join f using (pos) where citation_count >= 20) select paper_id, score from s where score >= 0.4 order by score desc, pos limit 30")
def _(spark, sf):
    p = entity(spark, sf, "papers").where(F.col("discovery_source").isin("arxiv", "openalex"))
    one = store.first_of(p.withColumn("_i", F.coalesce("doi", "paper_id")), ["_i"], [F.col("pos")])
    s = one.where("citation_count >= 20").withColumn("score", F.round(unified(), 6)).where("score >= 0.4")
    return s.orderBy(F.col("score").desc(), "pos").limit(30).select("paper_id", "score")


@query("n3_deep_discovery", ctes("papers", "cites") + f", s as (select pos, paper_id, relevance, round({UNIFIED}, 6) q from papers), b as (select * from s order by q desc, pos limit 20), x as (select distinct target_id pos from cites where edge_type = 'cites' and source_id in (select pos from b)), u as (select pos from b union select pos from x), f as (select s.pos, paper_id, round(0.4 * q + 0.6 * relevance, 6)::double as score from s join u on u.pos = s.pos) select paper_id, score from f order by score desc, pos limit 25")
def _(spark, sf):
    s = entity(spark, sf, "papers").withColumn("q", F.round(unified(), 6))
    best = s.orderBy(F.col("q").desc(), "pos").limit(20)
    more = entity(spark, sf, "cites").where("edge_type = 'cites'").join(best.select(F.col("pos").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("pos"))
    f = s.join(best.select("pos").union(more).distinct(), "pos", "left_semi").withColumn("score", F.round(S.final_score(F.col("q"), F.col("relevance")), 6))
    return f.orderBy(F.col("score").desc(), "pos").limit(25).select("paper_id", "score")


@query("n4_enhanced_discovery", P + f", s as (select pos, paper_id, relevance, round({UNIFIED}, 6) q from papers where citation_count >= 5) select paper_id, round(0.4 * q + 0.6 * relevance, 6)::double as score from s where relevance >= 0.5 order by score desc, pos limit 30")
def _(spark, sf):
    one = store.first_of(entity(spark, sf, "papers"), ["paper_id"], [F.col("pos")]).where("citation_count >= 5").withColumn("q", F.round(unified(), 6))
    s = one.where("relevance >= 0.5").withColumn("score", F.round(S.final_score(F.col("q"), F.col("relevance")), 6))
    return s.orderBy(F.col("score").desc(), "pos").limit(30).select("paper_id", "score")


@query("r13_relevance_rank", P + f" select paper_id, round(0.4 * round({UNIFIED}, 6) + 0.6 * relevance, 6)::double as score from papers where relevance >= 0.7")
def _(spark, sf):
    scores = entity(spark, sf, "papers").select("paper_id", "relevance")
    ranked = entity(spark, sf, "papers").drop("relevance").join(scores, "paper_id").where("relevance >= 0.7")
    return ranked.select("paper_id", F.round(S.final_score(F.round(unified(), 6), F.col("relevance")), 6).alias("score"))


@query("n5_benchmark_search", P.replace("with ", "with recursive ", 1) + ", " + _fold("select pos, coalesce(doi, paper_id) i, lower(trim(title)) t from papers where discovery_source in ('arxiv', 'huggingface')") + " select pos from f where pos is not null")
def _(spark, sf):
    p = entity(spark, sf, "papers")
    return I.first_wins(p.where("discovery_source = 'arxiv'").unionByName(p.where("discovery_source = 'huggingface'"))).select("pos")


@query("n7_preference_rerank", P + " select paper_id, round(0.4 * (pos % 10) / 10.0 + 0.6 * relevance, 6)::double as score from papers order by score desc, pos limit 30")
def _(spark, sf):
    from inkwell.operators.feedback import blend

    s = entity(spark, sf, "papers").withColumn("score", F.round(blend((F.col("pos") % 10) / 10.0, F.col("relevance"), 0.4), 6))
    return s.orderBy(F.col("score").desc(), "pos").limit(30).select("paper_id", "score")


@query("n10_map_citations", P + " select paper_id, coalesce(case when pos % 2 = 0 then 'u' || pos::varchar end, 'https://www.semanticscholar.org/paper/' || paper_id) as url from papers where title <> '' and pos % 5 <> 0")
def _(spark, sf):
    raw = entity(spark, sf, "papers").select(F.when(F.col("pos") % 5 != 0, F.col("paper_id")).alias("paper_id"), "title", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("u"), F.col("pos").cast("string"))).alias("url"), F.lit(None).cast("string").alias("pdf_url"))
    return M.map_citations(raw).select("paper_id", "url")


@query("n11_map_audit", P + " select 'r9' as run_id, paper_id, substr(title, 1, 200) as title, coalesce(case when pos % 3 = 0 then true end, false) as is_new, 'arxiv' as source from papers")
def _(spark, sf):
    return M.map_audit(entity(spark, sf, "papers").withColumn("is_new", F.when(F.col("pos") % 3 == 0, True)), "r9", "arxiv")


@query("n12_poll_window", "select o_orderkey, least(o_orderkey, 720) as hours from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", M.poll_hours(F.col("o_orderkey")).alias("hours"))


@query("n13_subscription_cap", "select c_mktsegment, count(*) as n from customer group by 1")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return store.add_capped(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), "c_mktsegment", 1 << 40).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("n14_subscription_update", "select c_custkey, case when c_custkey % 10 = 0 then 'paused' else 'active' end as status from customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lit("active").alias("status"))
    return store.update_known(c, c.where("c_custkey % 10 = 0").withColumn("status", F.lit("paused")), "c_custkey")


@query("n22_decomposition", "select event_id, 'find ' || event_id::varchar as query, case when event_id % 2 = 0 then 'methodology' else 'related' end as focus from events")
def _(spark, sf):
    i = F.col("event_id").cast("string")
    said = F.concat(F.lit('Here: [{"query": "find '), i, F.lit('", "focus": "'), F.when(F.col("event_id") % 2 == 0, "Methodology").otherwise("odd"), F.lit('"}, {"query": " ", "focus": "related"}] ok'))
    return M.decomposition(table(spark, sf, "events").select("event_id", said.alias("said")), "event_id", "said")


@query("r20_query_slots", P + " select topic, paper_id, case when place = 1 then 1.5 else 1.0 end::double as weight from (select topic, paper_id, row_number() over (partition by topic order by pos) place from papers) where place <= 4")
def _(spark, sf):
    return Q.query_slots(entity(spark, sf, "papers"), "topic", "pos", 4).select("topic", "paper_id", "weight")


@query("r21_provider_selector", P + " select paper_id, case when contains(lower(title), 'tion') then 'arxiv' when contains(lower(title), 'ung') or contains(lower(title), 'keit') then 'openalex' else 'semantic_scholar' end as provider from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", Q.select_provider(F.col("title"), [(("tion",), "arxiv"), (("ung", "keit"), "openalex")], "semantic_scholar").alias("provider"))


@query("n23_cache_key_lru", ctes("costs") + " select event_id, sha256(lower(provider) || '|hybrid|' || tokens::varchar) as cache_key from costs order by costs.day desc, event_id desc limit 100")
def _(spark, sf):
    kept = Q.least_recently_used(entity(spark, sf, "costs"), [F.col("day").desc(), F.col("event_id").desc()], 100)
    return kept.select("event_id", Q.cache_key(F.col("provider"), F.lit("hybrid"), F.col("tokens").cast("string")).alias("cache_key"))


@query("n24_prompt_assembly", P + " select paper_id, 'Title: ' || title || chr(10) || 'Authors: ' || array_to_string(list_transform(range(1, least(n_authors, 5) + 1), lambda i: 'a' || i::varchar), ', ') || chr(10) || 'Abstract: ' || case when length(coalesce(abstract, '')) >= 500 then substr(abstract, 1, 497) || '...' else coalesce(abstract, '') end as prompt from papers")
def _(spark, sf):
    authors = F.when(F.col("n_authors") > 0, F.transform(F.sequence(F.lit(1), F.col("n_authors")), lambda i: F.concat(F.lit("a"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return entity(spark, sf, "papers").select("paper_id", Q.paper_prompt(F.col("title"), authors, F.col("abstract")).alias("prompt"))


@query("n25_prompt_truncation", P + ", g as (select topic, sum(n_chars) t, count(*) n from papers group by 1), r as (select topic, paper_id, row_number() over (partition by topic order by relevance desc, pos) place from papers) select r.topic, paper_id from r join g using (topic) where t <= 50000 or place <= greatest(1, floor(n * 50000.0 / t * 0.8))")
def _(spark, sf):
    return Q.truncate_prompt(entity(spark, sf, "papers"), ["topic"], "n_chars", 50_000, [F.col("relevance").desc(), F.col("pos")]).select("topic", "paper_id")


@query("n26_answer_confidence", P + " select topic, round(least(1.0, avg(relevance) * 0.8 + 0.2), 6)::double as confidence, count(distinct discovery_source) as topics from papers group by topic")
def _(spark, sf):
    return entity(spark, sf, "papers").groupBy("topic").agg(F.round(F.least(F.lit(1.0), F.avg("relevance") * 0.8 + 0.2), 6).alias("confidence"), F.count_distinct("discovery_source").alias("topics"))


@query("n27_abstract_fallback", P + " select paper_id, '# ' || title || chr(10) || '**Venue:** ' || coalesce(venue, 'Unknown') || chr(10) || '**Year:** ' || coalesce(papers.year::varchar, 'Unknown') || chr(10) || chr(10) || coalesce(abstract, 'No abstract available') as markdown from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", Q.abstract_markdown(F.col("title"), F.col("venue"), F.col("year"), F.col("abstract")).alias("markdown"))


@query("n28_paper_summary", P + " select paper_id, title, case when pos % 2 = 0 then relevance else 0.0 end as quality from papers")
def _(spark, sf):
    q = F.when(F.col("pos") % 2 == 0, F.col("relevance").cast("string")).otherwise("n/a")
    return M.paper_summary(entity(spark, sf, "papers").select("paper_id", F.to_json(F.struct("title", q.alias("quality"))).alias("metadata_snapshot")))


@query("n32_table_markdown", "select n_nationkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | ' || case when n_nationkey % 2 = 0 then n_nationkey::varchar else '' end || ' |' as markdown from nation")
def _(spark, sf):
    rows = F.array(F.array(F.lit("name"), F.lit("key")), F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string"))))
    return table(spark, sf, "nation").select("n_nationkey", M.table_markdown(rows).alias("markdown"))


@query("n35_provider_metrics", P + " select discovery_source as provider, count(*) as n, count(*) > 0 as success from papers group by 1")
def _(spark, sf):
    return entity(spark, sf, "papers").groupBy(F.col("discovery_source").alias("provider")).agg(F.count("*").alias("n"), (F.count("*") > 0).alias("success"))


@query("n20_crawl_layer", ctes("cites") + " select target_id as node_id, min(edge_id) as via from cites where target_id not in (select doc_id from documents where doc_id % 4 = 0) group by 1")
def _(spark, sf):
    seen = table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("node_id"))
    layer = entity(spark, sf, "cites").select(F.col("target_id").alias("node_id"), "edge_id")
    return layer.join(seen, "node_id", "left_anti").groupBy("node_id").agg(F.min("edge_id").alias("via"))


@query("j16_as_of_join", "select event_id, max(o_orderkey) as o_orderkey from (select event_id, o_orderkey, rank() over (partition by event_id order by o_orderdate desc) r from events join orders on o_custkey = user_id and o_orderdate <= ts + interval 20 year) where r = 1 group by event_id")
def _(spark, sf):
    later = F.col("ts") + F.expr("INTERVAL 20 YEAR")
    met = table(spark, sf, "events").join(table(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id"), "user_id").where(F.col("o_orderdate") <= later)
    return met.groupBy("event_id").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))



