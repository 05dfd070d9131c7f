"""Queries of the other aggregations (E) and window-like functions (F)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators import reports as R
from inkwell.operators.graph import max_normalised, top_per
from inkwell.plans.registry import query
from inkwell.sources.entities import ctes, entity, table

P = ctes("papers")
C = ctes("costs")


@query("a10_source_breakdown", P + " select count(*) filter (discovery_source in ('arxiv', 'openalex')) as provider, count(*) filter (discovery_source not in ('arxiv', 'openalex')) as citation from papers")
def _(spark, sf):
    return R.partition_counts(entity(spark, sf, "papers"), "discovery_source", ("arxiv", "openalex"))


@query("a11_slo_percentages", P + " select round(100.0 * count(*) filter (abstract is null) / count(*), 2)::double as fallback, round(100.0 * count(*) filter (not pdf_available) / count(*), 2)::double as breadth from papers")
def _(spark, sf):
    p = entity(spark, sf, "papers")
    return p.agg(R.percentage(F.count_if(F.col("abstract").isNull()), F.count("*")).alias("fallback"), R.percentage(F.count_if(~F.col("pdf_available")), F.count("*")).alias("breadth"))


@query("a12_extraction_summary", C + " select count(*) as n, count(*) filter (tokens > 0) as ok, round(100.0 * count(*) filter (tokens > 0) / count(*), 1)::double as success_rate, sum(tokens)::bigint as tokens, round(avg(tokens), 4) as avg_tokens from costs")
def _(spark, sf):
    return R.extraction_summary(entity(spark, sf, "costs"))


_DUP = P + ", r as (select discovery_source as provider, lower(doi) as id, citation_count from papers where doi is not null)"


@query("a13_provider_comparison", _DUP + " select provider, count(*) as n, count(distinct id) as unique_ids, sum(citation_count)::bigint as citations from r group by 1")
def _(spark, sf):
    r = entity(spark, sf, "papers").where("doi is not null").select(F.col("discovery_source").alias("provider"), F.lower("doi").alias("id"), "citation_count")
    return r.groupBy("provider").agg(F.count("*").alias("n"), F.count_distinct("id").alias("unique_ids"), F.sum("citation_count").alias("citations"))


@query("a13_provider_overlap", _DUP + ", o as (select id from r group by id having count(*) > 1), c as (select provider, count(*) n from r group by 1) select (select count(*) from o) as overlap, (select count(distinct id) from r) as unique_ids, (select arg_max(provider, n * 1000 - ascii(provider)) from c) as most_results")
def _(spark, sf):
    r = entity(spark, sf, "papers").where("doi is not null").select(F.col("discovery_source").alias("provider"), F.lower("doi").alias("id"))
    return R.provider_overlap(r)


@query("a14_pdf_stats", P + " select round(avg(pdf_available::int), 6) as pdf_rate, round(avg(relevance), 6)::double as avg_all, round(avg(relevance) filter (pdf_available), 6)::double as avg_pdf, round(avg(relevance) filter (not pdf_available), 6)::double as avg_none from papers")
def _(spark, sf):
    a = lambda test: F.round(F.avg(F.when(test, F.col("relevance"))), 6)
    return entity(spark, sf, "papers").agg(F.round(F.avg(F.col("pdf_available").cast("int")), 6).alias("pdf_rate"), F.round(F.avg("relevance"), 6).alias("avg_all"), a(F.col("pdf_available")).alias("avg_pdf"), a(~F.col("pdf_available")).alias("avg_none"))


@query("a19_synthesis_stats", P + " select count(*) as n, count(*) filter (pdf_available) as with_pdf, count(*) filter (abstract is not null) as with_extraction, round(avg(relevance), 6)::double as avg_quality, max(relevance) as max_quality from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").agg(F.count("*").alias("n"), F.count_if("pdf_available").alias("with_pdf"), F.count_if(F.col("abstract").isNotNull()).alias("with_extraction"), F.round(F.avg("relevance"), 6).alias("avg_quality"), F.max("relevance").alias("max_quality"))


@query("a20_brief_counts", "select count(*) filter (o_orderstatus = 'F') as new, count(*) filter (o_orderstatus = 'O') as backfilled, count(*) filter (o_orderstatus not in ('F', 'O')) as skipped from orders")
def _(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(F.count_if(s == "F").alias("new"), F.count_if(s == "O").alias("backfilled"), F.count_if(~s.isin("F", "O")).alias("skipped"))


@query("a22_cost_ledger", C + " select provider, day::varchar as day, sum(tokens)::bigint as tokens, round(sum(tokens) / 1e6 * 2.0, 6)::double as cost from costs group by rollup (provider, day)")
def _(spark, sf):
    return R.cost_ledger(entity(spark, sf, "costs"), 2.0).withColumn("day", F.col("day").cast("string"))


@query("a22_budget_left", C + " select day::varchar as day, round(10.0 - sum(tokens) / 1e6 * 2.0, 6)::double as budget_left from costs group by day")
def _(spark, sf):
    return entity(spark, sf, "costs").groupBy(F.col("day").cast("string").alias("day")).agg(F.round(10.0 - F.sum("tokens") / 1e6 * 2.0, 6).alias("budget_left"))


@query("a23_cache_hit_rate", "select event_type, round(case when count(*) > 0 then count(*) filter (event_id % 3 = 0)::double / count(*) else 0 end, 6) as hit_rate from events group by 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("event_id") % 3 == 0), F.count("*")), F.lit(0.0)), 6).alias("hit_rate"))


_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0)


@query("a24_histogram", "select event_type, b as le, count(*) filter (value <= b) as n from events, (values (1.0::double), (5.0), (10.0), (50.0), (100.0)) v(b) group by 1, 2")
def _(spark, sf):
    return R.histogram(table(spark, sf, "events"), ["event_type"], "value", _BOUNDS)


@query("a26_registry_stats", P + " select count(*) as entries, count(distinct doi) as dois, count(distinct paper_id) as provider_ids from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").agg(F.count("*").alias("entries"), F.count_distinct("doi").alias("dois"), F.count_distinct("paper_id").alias("provider_ids"))


@query("a27_registry_hash", P + ", i as (select topic, paper_id || ':' || citation_count::varchar as item from papers) select * from (select topic, sha256(string_agg(part, '' order by bucket)) as registry_hash from (select topic, substr(sha256(item), 1, 3) as bucket, sha256(string_agg(item, '|' order by item)) as part from i group by 1, 2) group by 1)")
def _(spark, sf):
    return R.registry_hash(entity(spark, sf, "papers"), ["topic"], F.concat_ws(":", "paper_id", "citation_count"))


@query("a28_notification_status", "select o_custkey, case when count(*) filter (o_orderstatus = 'F') = 0 then 'success' when count(*) filter (o_orderstatus <> 'F') = 0 then 'failure' else 'partial' end as status from orders group by 1")
def _(spark, sf):
    failed, ok = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "F")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(R.run_status(ok, failed).alias("status"))


@query("a30_topics_covered", P + " select count(distinct t) as topics from (select topic t from papers union all select discovery_source from papers)")
def _(spark, sf):
    return entity(spark, sf, "papers").select(F.explode(F.array("topic", "discovery_source")).alias("t")).agg(F.count_distinct("t").alias("topics"))


@query("w1_top_per_topic", P + " select topic, paper_id, row_number() over (partition by topic order by relevance desc, pos)::int as place from papers qualify place <= 3")
def _(spark, sf):
    return top_per(entity(spark, sf, "papers"), ["topic"], [F.col("relevance").desc(), F.col("pos")], 3, "place").select("topic", "paper_id", "place")


@query("w2_max_normalised", P + " select paper_id, round(case when max(citation_count) over (partition by topic) > 0 then citation_count::double / max(citation_count) over (partition by topic) else 0 end, 6) as score from papers")
def _(spark, sf):
    return max_normalised(entity(spark, sf, "papers"), "citation_count", ["topic"], "score").select("paper_id", F.round("score", 6).alias("score"))


@query("w7_budget_prefix", P + " select topic, paper_id from (select topic, paper_id, coalesce(sum(n_chars) over (partition by topic order by relevance desc, pos rows between unbounded preceding and 1 preceding), 0) as spent from papers) where spent < 20000")
def _(spark, sf):
    w = W.partitionBy("topic").orderBy(F.col("relevance").desc(), "pos").rowsBetween(W.unboundedPreceding, -1)
    return entity(spark, sf, "papers").withColumn("spent", F.coalesce(F.sum("n_chars").over(w), F.lit(0))).where("spent < 20000").select("topic", "paper_id")
