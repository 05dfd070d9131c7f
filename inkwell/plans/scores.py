"""Queries of the composite scores, the filters (C) and the orders (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores as S
from inkwell.functions import text as T
from inkwell.functions.time import within
from inkwell.operators import store
from inkwell.plans.registry import query
from inkwell.plans.scalars import VENUES, _first
from inkwell.sources import mappers as M
from inkwell.sources.entities import AS_OF, AS_OF_YEAR, ctes, entity, table

P = ctes("papers")
DAY = f"date '{AS_OF}'"
_LONGEST = f"case when venue is null then 0.5 {_first(sorted(VENUES.items(), key=lambda x: -len(x[0])))} else 0.5 end"
_FIRST = f"case when venue is null then 0.5 {_first(VENUES.items())} else 0.5 end"
_C1 = "case when citation_count > 0 then least(1.0, log10(citation_count + 1) / 3 + case when influential > 0 then least(0.1, influential * 0.01) else 0 end) else 0 end"
_C1N = "case when citation_count > 0 then least(1.0, log10(citation_count + 1) / 3) else 0 end"
_C2 = "case when citation_count > 0 then least(1.0, ln(1 + citation_count) / 10 + case when influential is null then 0.05 when influential > 0 then least(0.1, influential * 0.01) else 0 end) else 0 end"
_R1 = f"case when publication_date is null or publication_date > {DAY} then 0.5 when date_diff('day', publication_date, {DAY}) < 365 then 1 when date_diff('day', publication_date, {DAY}) < 730 then 0.75 when date_diff('day', publication_date, {DAY}) < 1825 then 0.5 else 0.25 end"
_R2 = "case when publication_date is null then 0.5 else greatest(0.1, 1 / (1 + 0.2 * greatest(0, 2024 - year(publication_date)))) end"
_R3 = "case when year is null or year > 2024 then 0.5 else greatest(0, 1 - (2024 - year) / 10.0) end"
_DAY4 = "date_diff('day', coalesce(publication_date, make_date(year, 6, 15)), " + DAY + ")"
_R4 = f"case when publication_date is null and year is null then 0.5 when {_DAY4} <= 365 then 1 when {_DAY4} >= 1825 then 0 else 1 - ({_DAY4} - 365) / 1460.0 end"
_L = "case when length(trim(abstract)) > 0 then 0.5 else 0 end + case when n_authors > 0 then 0.3 else 0 end + case when doi <> '' then 0.2 else 0 end"
_F5 = "case when {a} then 0.3 else 0 end + case when n_authors > 0 then 0.2 else 0 end + case when venue <> '' then 0.2 else 0 end + case when pdf_available then 0.2 else 0 end + case when doi <> '' then 0.1 else 0 end"
_F5A, _F5B = _F5.format(a="length(trim(abstract)) >= 50"), _F5.format(a="length(abstract) > 50")
LEGACY = f"least(100.0, 100.0 * (0.4 * ({_C1}) + 0.3 * ({_FIRST}) + 0.2 * ({_R1}) + 0.1 * ({_L})))"
UNIFIED = f"(0.25 * ({_C2}) + 0.20 * ({_LONGEST}) + 0.20 * ({_R2}) + 0.15 * 0.5 + 0.10 * ({_F5A}) + 0.10 * 0.5)"
FILTERED = f"(0.25 * least(1.0, ln(1 + citation_count) / 10) + 0.20 * ({_LONGEST}) + 0.20 * ({_R2}) + 0.15 * 0 + 0.10 * ({_F5B}) + 0.10 * 0.5)"
RANKED = f"(0.3 * ({_C1N}) + 0.3 * ({_R4}) + 0.2 * least(1.0, 1 / 3.0) + 0.2 * case when pdf_available then 1 else 0 end)"
_c = F.col


def _as_of():
    return F.lit(AS_OF).cast("date")


def _venue_key():
    return F.lower(F.trim(F.coalesce("venue", F.lit(""))))


def legacy():
    """F-MATH3."""
    parts = {"citation": S.citation_log10(_c("citation_count"), _c("influential")), "venue": S.venue_first(_c("venue"), VENUES, 0.5), "recency": S.recency_steps(_c("publication_date"), _as_of()), "completeness": S.completeness_legacy(_c("abstract"), _c("n_authors"), _c("doi"))}
    return F.least(F.lit(100.0), 100.0 * S.weighted(parts, S.LEGACY_WEIGHTS))


def unified():
    """F-MATH4: papers carry no upvotes, so engagement is neutral."""
    parts = {
        "citation": S.citation_log1p_bonus(_c("citation_count"), _c("influential")), "venue": S.venue_longest(_venue_key(), VENUES, 0.5), "recency": S.recency_decay(F.year("publication_date"), AS_OF_YEAR), "engagement": F.lit(0.5),
        "completeness": S.completeness_five(_c("abstract"), _c("n_authors"), _c("venue"), _c("pdf_available"), _c("doi")), "author": F.lit(0.5),
    }
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.weighted(parts, S.SIX_WEIGHTS)))


def filtered():
    """F-MATH5: over the sum of the weights; without upvotes engagement is 0."""
    parts = {
        "citation": S.citation_log1p(_c("citation_count")), "venue": S.venue_longest(_venue_key(), VENUES, 0.5), "recency": S.recency_decay(F.year("publication_date"), AS_OF_YEAR), "engagement": F.lit(0.0),
        "completeness": S.completeness_five(_c("abstract"), _c("n_authors"), _c("venue"), _c("pdf_available"), _c("doi"), strict=True), "author": F.lit(0.5),
    }
    return S.weighted(parts, S.SIX_WEIGHTS) / sum(S.SIX_WEIGHTS.values())


def ranked(source_count=None):
    """F-MATH6."""
    sources = F.lit(1) if source_count is None else source_count
    parts = {"citation": S.citation_log10(_c("citation_count")), "recency": S.recency_five_years(_c("publication_date"), _c("year"), _as_of()), "sources": F.least(F.lit(1.0), sources / 3), "pdf": F.when(_c("pdf_available"), 1.0).otherwise(0.0)}
    return S.weighted(parts, S.RANKING_WEIGHTS)


@query("f_math3_6_composites", P + f" select paper_id, round({LEGACY}, 6)::double legacy, round({UNIFIED}, 6)::double unified, round({FILTERED}, 6)::double filtered, round({RANKED}, 6)::double ranked from papers")
def _(spark, sf):
    made = {"legacy": legacy(), "unified": unified(), "filtered": filtered(), "ranked": ranked()}
    return entity(spark, sf, "papers").select("paper_id", *(F.round(x, 6).alias(n) for n, x in made.items()))


@query("f_math7_tiers", P + f" select case when round({UNIFIED}, 6) >= 0.8 then 'excellent' when round({UNIFIED}, 6) >= 0.6 then 'good' when round({UNIFIED}, 6) >= 0.4 then 'fair' else 'low' end as tier, count(*) as n from papers group by 1")
def _(spark, sf):
    return entity(spark, sf, "papers").groupBy(S.tier(F.round(unified(), 6)).alias("tier")).agg(F.count("*").alias("n"))


@query("p1_citation_year_filter", P + " select paper_id from papers where citation_count >= 100 and (year is null or year between 2016 and 2022)")
def _(spark, sf):
    return entity(spark, sf, "papers").where((_c("citation_count") >= 100) & (_c("year").isNull() | _c("year").between(2016, 2022))).select("paper_id")


@query("p2_quality_filter", P + f" select paper_id, round({UNIFIED}, 6)::double as score from papers where citation_count >= 50 and round({UNIFIED}, 6) >= 0.5")
def _(spark, sf):
    return entity(spark, sf, "papers").where("citation_count >= 50").select("paper_id", F.round(unified(), 6).alias("score")).where("score >= 0.5")


@query("p3_term_filter", P + " select paper_id from papers where contains(lower(title || ' ' || coalesce(abstract, '')), 'the and') and contains(lower(title || ' ' || coalesce(abstract, '')), 'tion')")
def _(spark, sf):
    terms = M.query_terms('"the and" AND (tion OR of)')
    assert terms == ["the and", "tion"]
    return entity(spark, sf, "papers").where(M.all_terms(terms, F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))))).select("paper_id")


@query("s3_boolean_query", P + """, t as (select paper_id, lower(title) a, lower(coalesce(abstract, '')) b from papers)
    select paper_id from t where ((contains(a, 'the and') or contains(b, 'the and')) or (contains(a, 'ung') or contains(b, 'ung'))) and not (contains(a, 'ierr') or contains(b, 'ierr'))""")
def _(spark, sf):
    return entity(spark, sf, "papers").where(M.boolean_query('("the and" OR ung) AND NOT ierr', _c("title"), _c("abstract"))).select("paper_id")


@query("p5_timeframes", P + f" select paper_id, coalesce(publication_date >= {DAY} - 700, false) as recent, coalesce(year(publication_date) >= 2020, false) as since_year, coalesce(publication_date between date '2018-01-01' and date '2020-12-31', false) as in_range from papers")
def _(spark, sf):
    at, now = _c("publication_date").cast("timestamp"), F.lit(AS_OF).cast("timestamp")
    return entity(spark, sf, "papers").select("paper_id", within(at, now, recent="700d").alias("recent"), within(at, now, since_year=2020).alias("since_year"), within(at, now, date_range=("2018-01-01", "2020-12-31")).alias("in_range"))


@query("p6_crawl_filter", ctes("nodes", "cites") + ", k as (select node_id from nodes where citation_count >= 200 and coalesce(year >= 2016, false)) select edge_id from cites where source_id in (select node_id from k) or target_id in (select node_id from k)")
def _(spark, sf):
    kept = entity(spark, sf, "nodes").where((_c("citation_count") >= 200) & F.coalesce(_c("year") >= 2016, F.lit(False))).select("node_id")
    edges = entity(spark, sf, "cites")
    by = lambda c: edges.join(kept.withColumnRenamed("node_id", c), c, "left_semi").select("edge_id")
    return by("source_id").union(by("target_id")).distinct()


@query("p6_crawl_drop_counts", ctes("nodes") + " select count(*) filter (citation_count < 200) as few_citations, count(*) filter (citation_count >= 200 and not coalesce(year >= 2016, false)) as too_old, count(*) filter (citation_count >= 200 and year >= 2016) as kept from nodes")
def _(spark, sf):
    few, old = _c("citation_count") < 200, ~F.coalesce(_c("year") >= 2016, F.lit(False))
    return entity(spark, sf, "nodes").agg(F.count_if(few).alias("few_citations"), F.count_if(~few & old).alias("too_old"), F.count_if(~few & ~old).alias("kept"))


@query("p7_year_filter", P + " select paper_id, coalesce(year, try_cast(substr(publication_date::varchar, 1, 4) as int)) as y from papers where coalesce(year, try_cast(substr(publication_date::varchar, 1, 4) as int)) >= 2020")
def _(spark, sf):
    y = F.coalesce("year", F.expr("try_cast(substring(cast(publication_date as string), 1, 4) as int)"))
    return entity(spark, sf, "papers").select("paper_id", y.alias("y")).where("y >= 2020")


@query("p8_property_search", ctes("nodes") + " select node_id from nodes where json_extract_string(properties, '$.lang') = 'de' and node_type = 'paper' order by node_id limit 20")
def _(spark, sf):
    return store.by_property(entity(spark, sf, "nodes"), "lang", "de", "paper", 20).select("node_id")


@query("p11_topic_filter", P + f" select paper_id from papers where topic in ('t1', 't2', 't3') and topic not in ('t3') and round({UNIFIED}, 6) >= 0.4")
def _(spark, sf):
    topics = F.array("topic")
    inside, outside = F.arrays_overlap(topics, F.array(*map(F.lit, ("t1", "t2", "t3")))), F.arrays_overlap(topics, F.array(F.lit("t3")))
    return entity(spark, sf, "papers").where(inside & ~outside).where(F.round(unified(), 6) >= 0.4).select("paper_id")


@query("p12_relevance_threshold", "with q as (select embedding::double[] q from embeddings where vec_id = 0), s as (select vec_id, round(list_cosine_similarity(embedding::double[], q), 5) as relevance from embeddings, q) select vec_id, relevance from s where relevance >= 0.2")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    # The query is one vector.
    asked = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    scored = e.select("vec_id", F.round(S.cosine(F.col("embedding"), F.array(*map(F.lit, asked))), 5).alias("relevance"))
    return scored.where("relevance >= 0.2")


@query("p13_registry_topics", P + f" select paper_id from papers where topic = 't2' and publication_date >= {DAY} - 1500")
def _(spark, sf):
    return entity(spark, sf, "papers").withColumn("topics", F.array("topic")).where(F.array_contains("topics", "t2") & (_c("publication_date") >= F.date_sub(_as_of(), 1500))).select("paper_id")


@query("p14_citation_seeds", P + f" select paper_id, round({LEGACY}, 6)::double as score from papers where round({LEGACY}, 6) >= 60 order by round({LEGACY}, 6) desc, pos limit 10")
def _(spark, sf):
    return entity(spark, sf, "papers").withColumn("score", F.round(legacy(), 6)).where("score >= 60").orderBy(_c("score").desc(), "pos").limit(10).select("paper_id", "score")


@query("p15_pending_work", P + " select paper_id from papers where pos % 3 <> 0")
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    done = papers.where("pos % 3 = 0").select("paper_id")
    return papers.join(done, "paper_id", "left_anti").select("paper_id")


@query("p16_edges_of_node", ctes("cites") + " select edge_id from cites where source_id = 6 union all select edge_id from cites where target_id = 6")
def _(spark, sf):
    return store.edges_of(entity(spark, sf, "cites"), 6).select("edge_id")


@query("p17_high_score_guard", P + " select paper_id, case when relevance >= 0.95 and length(coalesce(abstract, '')) < 200 then null else relevance end as relevance from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", F.when((_c("relevance") >= 0.95) & (F.length(F.coalesce("abstract", F.lit(""))) < 200), None).otherwise(_c("relevance")).alias("relevance"))


@query("p18_query_validation", P + r""" select paper_id, regexp_matches(title, '^[\p{L}\p{N}\s.,:;''"()+-]+$') and not regexp_matches(title, '[;|&`$<>]|\.\./') as valid from papers""")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", (_c("title").rlike(r"""^[\p{L}\p{N}\s.,:;'"()+-]+$""") & ~_c("title").rlike(r"[;|&`$<>]|\.\./")).alias("valid"))


@query("p19_scored_projection", P + f" select paper_id, title, round({UNIFIED} * 100, 4)::double as quality, relevance from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", "title", F.round(unified() * 100, 4).alias("quality"), "relevance")


def _top(name, sql_score, score, floor, order, n):
    q = P + f", s as (select pos, paper_id, round({sql_score}, 6)::double as score, relevance, influential, citation_count, publication_date, year from papers) select paper_id, score from s where score >= {floor} order by {order} limit {n}"

    @query(name, q)
    def _(spark, sf):
        s = entity(spark, sf, "papers").withColumn("score", F.round(score(), 6)).where(F.col("score") >= floor)
        return s.orderBy(F.col("score").desc(), "pos").limit(n).select("paper_id", "score")


_top("o1_rank_papers", LEGACY, legacy, 40, "score desc, pos", 100)
_top("o4_rank_cap", RANKED, ranked, 0, "score desc, pos", 50)
_top("n1_surface_discovery", UNIFIED, unified, 0.3, "score desc, pos", 25)
_top("n31_legacy_ranking", f"({UNIFIED}) * 100", lambda: unified() * 100, 50, "score desc, pos", 40)


@query("o2_influence_order", P + """ select paper_id, row_number() over (order by coalesce(influential, 0) desc, citation_count desc, coalesce(publication_date, make_date(year, 1, 1)) desc nulls last, pos) as place from papers where citation_count > 800""")
def _(spark, sf):
    from pyspark.sql import Window as W

    best = entity(spark, sf, "papers").where("citation_count > 800")
    date = F.coalesce("publication_date", F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    order = [F.coalesce("influential", F.lit(0)).desc(), F.col("citation_count").desc(), date.desc_nulls_last(), F.col("pos")]
    return best.select("paper_id", F.row_number().over(W.orderBy(*order)).alias("place"))


@query(
    "o3_filter_rank",
    P + rf""", w as (select *, list_distinct(list_filter(string_split_regex(lower(title || ' ' || coalesce(abstract, '')), '\s+'), lambda x: x <> '')) t from papers where citation_count >= 10),
    s as (select paper_id, pos, round(0.30 * case when citation_count > 0 then least(1.0, log10(citation_count) / 3) else 0 end + 0.20 * ({_R3}) + 0.50 * len(list_intersect(['the', 'of', 'that'], t))::double / len(list_distinct(list_concat(['the', 'of', 'that'], t))), 6)::double as score from w)
    select paper_id, score from s order by score desc, pos limit 60""",
)
def _(spark, sf):
    text = F.concat_ws(" ", "title", F.coalesce("abstract", F.lit("")))
    parts = {"citation": S.citation_log10_plain(_c("citation_count")), "recency": S.recency_ten_years(_c("year"), AS_OF_YEAR), "relevance": T.word_overlap(F.lit("the of that"), text)}
    s = entity(spark, sf, "papers").where("citation_count >= 10").withColumn("score", F.round(S.weighted(parts, S.FILTER_WEIGHTS), 6))
    return s.orderBy(_c("score").desc(), "pos").limit(60).select("paper_id", "score")


@query("o5_final_score", P + f" select paper_id, round(coalesce(0.4 * {UNIFIED} + 0.6 * case when pos % 4 = 0 then null else relevance end, {UNIFIED}), 6)::double as final from papers order by final desc, pos limit 40")
def _(spark, sf):
    f = F.round(S.final_score(unified(), F.when(_c("pos") % 4 != 0, _c("relevance"))), 6)
    return entity(spark, sf, "papers").withColumn("final", f).orderBy(_c("final").desc(), "pos").limit(40).select("paper_id", "final")


@query("o9_paged_nodes", ctes("nodes") + " select node_id, created_at from nodes where node_type = 'paper' order by created_at desc, node_id limit 20 offset 40")
def _(spark, sf):
    return store.page(entity(spark, sf, "nodes").where("node_type = 'paper'"), [_c("created_at").desc(), _c("node_id")], 40, 20).select("node_id", "created_at")


@query("o10_digest_order", P + " select paper_id, case when pos % 5 = 0 then null else relevance end as score from papers order by coalesce(case when pos % 5 = 0 then null else relevance end, -1) desc, paper_id limit 20")
def _(spark, sf):
    s = entity(spark, sf, "papers").select("paper_id", F.when(_c("pos") % 5 != 0, _c("relevance")).alias("score"))
    return s.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "paper_id").limit(20)


@query("o11_run_listing", "select o_orderkey as run_id, o_orderdate::varchar as started_at from orders order by orders.o_orderdate desc, o_orderkey limit 25")
def _(spark, sf):
    runs = table(spark, sf, "orders").orderBy(_c("o_orderdate").desc(), "o_orderkey").limit(25)
    return runs.select(_c("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("o12_subscription_listing", "select c_custkey as subscription_id from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 order by c_custkey limit 50")
def _(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0").orderBy("c_custkey").limit(50).select(_c("c_custkey").alias("subscription_id"))


@query("o13_best_extraction", "select l_orderkey as doc, arg_max(l_linenumber, l_extendedprice * 1000 - l_linenumber) as backend, max(l_extendedprice) as quality from lineitem group by l_orderkey")
def _(spark, sf):
    best = F.max(F.struct("l_extendedprice", (-_c("l_linenumber")).alias("m")))
    return table(spark, sf, "lineitem").groupBy(_c("l_orderkey").alias("doc")).agg(best.alias("b")).select("doc", (-_c("b.m")).alias("backend"), _c("b.l_extendedprice").alias("quality"))


@query("o15_brief_order", P + " select paper_id, case when pos % 2 = 0 then 'new' else 'backfilled' end as section, row_number() over (partition by pos % 2 order by relevance desc, pos) as place from papers")
def _(spark, sf):
    from inkwell.operators.graph import top_per

    rows = entity(spark, sf, "papers").withColumn("section", F.when(_c("pos") % 2 == 0, "new").otherwise("backfilled"))
    return top_per(rows, ["section"], [_c("relevance").desc(), _c("pos")], 1 << 30, "place").select("paper_id", "section", "place")


@query("n30_filter_and_score", P + f" select paper_id, round({FILTERED}, 6)::double as score from papers where citation_count >= 20 and round({FILTERED}, 6) >= 0.4")
def _(spark, sf):
    return entity(spark, sf, "papers").where("citation_count >= 20").select("paper_id", F.round(filtered(), 6).alias("score")).where("score >= 0.4")
