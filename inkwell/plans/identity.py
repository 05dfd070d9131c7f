"""Queries of identity resolution and deduplication (D, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores as S
from inkwell.operators import identity as I
from inkwell.operators import store
from inkwell.plans.registry import query
from inkwell.sources.entities import AS_OF, ctes, entity, table

P = ctes("papers")
_KEY = r"trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_LOOSE = r"""translate(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), '.,;:!?()-"''', '')"""
_SPLIT = P + ", reg as (select pos as entry_id, lower(doi) as doi, 'semantic_scholar:' || paper_id as provider_key, title, topic from papers where pos % 2 = 0), inc as (select pos, case when pos % 9 = 1 then 'p' || (pos - 1)::varchar else paper_id end as paper_id, lower(doi) as doi, title, topic from papers where pos % 2 = 1)"


def _halves(spark, sf):
    papers = entity(spark, sf, "papers")
    reg = papers.where("pos % 2 = 0").select(F.col("pos").alias("entry_id"), F.lower("doi").alias("doi"), F.concat(F.lit("semantic_scholar:"), "paper_id").alias("provider_key"), "title", "topic")
    inc = papers.where("pos % 2 = 1").select("pos", F.when(F.col("pos") % 9 == 1, F.concat(F.lit("p"), (F.col("pos") - 1).cast("string"))).otherwise(F.col("paper_id")).alias("paper_id"), F.lower("doi").alias("doi"), "title", "topic")
    return reg, inc


_J1 = _SPLIT + """, m as (select inc.*, (select max(entry_id) from reg where reg.doi = inc.doi) d, (select max(entry_id) from reg where reg.provider_key = 'semantic_scholar:' || inc.paper_id) k from inc)"""


@query("j1_resolve_exact", _J1 + " select pos, coalesce(d, k) as entry_id, case when d is not null then 'doi' when k is not null then 'semantic_scholar' end as method from m")
def _(spark, sf):
    reg, inc = _halves(spark, sf)
    return I.resolve_exact(inc, reg).select("pos", "entry_id", "method")


_G3 = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 2)), lambda i: substr({0}, i, 3)))"


@query(
    "j2_fuzzy_titles",
    _SPLIT + f""", a as (select pos as l, {_KEY} k from inc), b as (select entry_id as r, {_KEY} k from reg), ak as (select distinct k, {_G3.format('k')} g from a where k <> ''), bk as (select k, min(r) r, {_G3.format('k')} g from b where k <> '' group by k),
    s as (select ak.k x, bk.k y, bk.r, case when ak.k = bk.k then 1.0 else len(list_intersect(ak.g, bk.g))::double / len(list_distinct(list_concat(ak.g, bk.g))) end sim from ak join bk on len(ak.g) >= 0.95 * len(bk.g) and len(bk.g) >= 0.95 * len(ak.g))
    select a.l, arg_max(s.r, sim * 1e9 - s.r) as r, round(max(sim), 6)::double as similarity from a join s on s.x = a.k where sim >= 0.95 group by a.l""",
)
def _(spark, sf):
    reg, inc = _halves(spark, sf)
    return I.fuzzy_titles(inc.select(F.col("pos").alias("l"), "title"), reg.select(F.col("entry_id").alias("r"), "title")).withColumn("similarity", F.round("similarity", 6))


@query("j3_dedup_against_index")
def _(spark, sf):
    reg, inc = _halves(spark, sf)
    return I.dedup_against(inc.select("pos", "doi", "title"), reg.select("doi", "title")).select("pos")


def _fold(rows: str) -> str:
    """Rows (pos, i, t) in order of pos: one is kept unless a kept one has its i or t."""
    return f"""k as materialized (select pos, hash('i' || i) i, hash('t' || t) t, row_number() over (order by pos) n from ({rows})),
    f as (select 0::bigint n, []::ubigint[] seen, null::bigint pos union all select k.n, case when list_contains(f.seen, k.i) or list_contains(f.seen, k.t) then f.seen else list_concat(f.seen, [k.i, k.t]) end,
      case when list_contains(f.seen, k.i) or list_contains(f.seen, k.t) then null else k.pos end from f join k on k.n = f.n + 1)"""


_FRESH = f"select pos, coalesce(doi, paper_id) i, case when {_KEY} = '' then chr(1) || pos::varchar else {_KEY} end t from inc where (doi is null or doi not in (select doi from reg where doi is not null)) and ({_KEY} = '' or {_KEY} not in (select {_KEY} from reg))"


@query("j4_discovery_filter", _SPLIT.replace("with ", "with recursive ", 1) + ", " + _fold(_FRESH) + f""" select inc.pos, f.pos is not null as is_new, case when f.pos is not null then null when inc.doi in (select doi from reg where doi is not null) then 'doi'
    when {_KEY} <> '' and {_KEY} in (select {_KEY} from reg) then 'title' else 'batch' end as reason from inc left join f on f.pos = inc.pos""")
def _(spark, sf):
    reg, inc = _halves(spark, sf)
    return I.discovery_filter(inc.select("pos", "paper_id", "doi", "title"), reg.select("doi", "title"))


@query("j5_registry_action", _J1 + " select pos, case when coalesce(d, k) is null then 'full_process' when coalesce(d, k) % 10 = 4 then 'backfill' when (coalesce(d, k) % 7) = (pos % 7) then 'skip' else 'map_only' end as action from m")
def _(spark, sf):
    reg, inc = _halves(spark, sf)
    found = I.resolve_exact(inc, reg).withColumns({"old_hash": F.when(F.col("entry_id") % 10 == 4, "old").otherwise("h"), "new_hash": F.lit("h"), "known": F.coalesce(F.col("entry_id") % 7 == F.col("pos") % 7, F.lit(False))})
    return found.select("pos", I.action(found, "entry_id", "old_hash", "new_hash", "known").alias("action"))


_KEYS = f"select pos, 'doi:' || lower(trim(doi)) k from papers where doi is not null union all select pos, 'arxiv:' || lower(trim(arxiv_id)) from papers where arxiv_id is not null union all select pos, 'pid:' || paper_id from papers union all select pos, 'title:' || {_LOOSE} from papers where {_LOOSE} <> ''"
_U5 = P.replace("with ", "with recursive ", 1) + f", k as materialized (select distinct * from ({_KEYS})), e as materialized (select distinct a.pos x, b.pos y from (select k, min(pos) pos from k group by k) a join k b using (k)), s as materialized (select x, y from e union select y, x from e), w as (select pos x, pos y from papers union select w.x, s.y from w join s on s.x = w.y), c as (select x as pos, min(y) component from w group by x)"


@query("u5_components", _U5 + " select pos, component from c")
def _(spark, sf):
    return I.components(I.paper_keys(entity(spark, sf, "papers")))


_COMPLETE = "case when doi <> '' then 3 else 0 end + case when abstract <> '' then 2 else 0 end + case when n_authors > 0 then 1 else 0 end + case when venue <> '' then 1 else 0 end + case when pdf_available then 2 else 0 end + case when citation_count > 0 then 1 else 0 end"


def _complete():
    c = F.col
    return S.completeness_rank(c("doi"), c("abstract"), c("n_authors"), c("venue"), c("pdf_available"), c("citation_count"))


@query(
    "a15_merge_groups",
    _U5 + f""", r as (select papers.*, component, {_COMPLETE} f from papers join c using (pos)), g as (select component, arg_max(pos, f * 1e9 - pos) base, count(*) source_count, max(citation_count) citation_count, bool_or(pdf_available) pdf_available,
      arg_min(doi, pos) filter (doi is not null) d, arg_min(venue, pos) filter (venue is not null) v from r group by component)
    select g.component, r.paper_id, coalesce(r.doi, d) as doi, coalesce(r.venue, v) as venue, g.citation_count, g.pdf_available, g.source_count from g join r on r.pos = g.base""",
)
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    return I.merge_groups(papers, I.components(I.paper_keys(papers)), _complete()).select("component", "paper_id", "doi", "venue", "citation_count", "pdf_available", "source_count")


@query("w4_first_wins", P.replace("with ", "with recursive ", 1) + ", " + _fold("select pos, coalesce(doi, paper_id) i, lower(trim(title)) t from papers") + " select pos from f where pos is not null")
def _(spark, sf):
    return I.first_wins(entity(spark, sf, "papers").select("pos", "paper_id", "doi", "title")).select("pos")


@query("w3_first_by_id", P + " select venue, min(pos) as pos from papers where venue is not null group by venue")
def _(spark, sf):
    return store.first_of(entity(spark, sf, "papers").where("venue is not null"), ["venue"], [F.col("pos")]).select("venue", "pos")


@query("u2_multi_source_concat", P + " select paper_id, discovery_source as source from papers where pos % 2 = 0 union all select paper_id, 'backup' from papers where pos % 2 = 1")
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    a = papers.where("pos % 2 = 0").select("paper_id", F.col("discovery_source").alias("source"))
    b = papers.where("pos % 2 = 1").select("paper_id")
    return a.unionByName(b, allowMissingColumns=True).withColumn("source", F.coalesce("source", F.lit("backup")))


@query("u7_explorer_seen", P + " select count(*) filter (pos % 2 = 1) as seen_before, count(distinct doi) filter (pos % 2 = 0) as new_dois from papers")
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    seen = papers.where("pos % 2 = 1").select("paper_id")
    dup = papers.join(seen, "paper_id", "left_semi").agg(F.count("*").alias("seen_before"))
    return dup.join(F.broadcast(papers.join(seen, "paper_id", "left_anti").agg(F.count_distinct("doi").alias("new_dois"))))  # single rows


@query("j11_feedback_features", ctes("feedback") + " select paper_id, rating, label from feedback join embeddings on vec_id = paper_id")
def _(spark, sf):
    return entity(spark, sf, "feedback").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_id"), "label"), "paper_id").select("paper_id", "rating", "label")


@query("j12_title_lookup", ctes("papers") + " select vec_id, coalesce(title, vec_id::varchar) as title from embeddings left join papers on pos = vec_id and pos % 2 = 0")
def _(spark, sf):
    titles = entity(spark, sf, "papers").where("pos % 2 = 0").select(F.col("pos").alias("vec_id"), "title")
    return table(spark, sf, "embeddings").select("vec_id").join(titles, "vec_id", "left").select("vec_id", F.coalesce("title", F.col("vec_id").cast("string")).alias("title"))


@query("j13_cache_or_compute", P + " select paper_id, case when pos % 3 = 0 and pos % 2 = 0 then -1 else citation_count end as value from papers")
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    cache = papers.where("pos % 3 = 0").select("paper_id", F.lit(-1).alias("value"), F.when(F.col("pos") % 2 == 0, F.lit("2024-01-28").cast("date")).otherwise(F.lit("2023-12-01").cast("date")).alias("computed_at"))
    compute = lambda keys: keys.join(papers.select("paper_id", F.col("citation_count").alias("value")), "paper_id").withColumn("computed_at", F.lit(AS_OF).cast("date"))
    return I.cache_or_compute(papers, cache, "paper_id", AS_OF, 7, compute).select("paper_id", "value")


@query("j14_digest_titles", _SPLIT + " select inc.pos, coalesce(a.title, b.title, inc.paper_id) as title from inc left join reg a on a.entry_id = inc.pos + 1 and inc.pos % 3 = 0 left join reg b on b.provider_key = 'semantic_scholar:' || inc.paper_id")
def _(spark, sf):
    reg, inc = _halves(spark, sf)
    by_id = reg.select(F.col("entry_id").alias("_e"), F.col("title").alias("_a"))
    by_key = reg.select("provider_key", F.col("title").alias("_b"))
    got = inc.withColumns({"_e": F.when(F.col("pos") % 3 == 0, F.col("pos") + 1), "provider_key": I.provider_key(F.col("paper_id"))}).join(by_id, "_e", "left").join(by_key, "provider_key", "left")
    return got.select("pos", F.coalesce("_a", "_b", "paper_id").alias("title"))


@query("j15_supplement", P + f", m as (select *, {_KEY} k from papers where pos % 2 = 1), x as (select *, {_KEY} k from papers where pos % 2 = 0) select paper_id from m union all select paper_id from x where k not in (select k from m) and paper_id not in (select paper_id from m)")
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    return I.supplement(papers.where("pos % 2 = 1"), papers.where("pos % 2 = 0"), 0.3).select("paper_id")


@query(
    "w8_diverse_sample",
    P + """, r as (select pos, [topic, discovery_source] ts, row_number() over (order by relevance desc, pos) k from papers), b as (select t, min(k) k from (select k, unnest(ts) t from r) group by t),
    d as (select distinct k from b where k > 24 order by k limit 6), h as (select k from r where k <= 24 union all select k from d), x as (select k, row_number() over (order by k) n from r where k not in (select k from h))
    select pos from r where k in (select k from h) or k in (select k from x where n <= 30 - (select count(*) from h))""",
)
def _(spark, sf):
    return I.diverse_sample(entity(spark, sf, "papers").select("pos", F.col("relevance").alias("quality"), F.array("topic", "discovery_source").alias("topics")), 30).select("pos")


@query("n6_multi_source_aggregate", _U5 + f""", r as (select papers.*, component, {_COMPLETE} f from papers join c using (pos)), g as (select component, arg_max(pos, f * 1e9 - pos) base, count(*) source_count, max(citation_count) cc, bool_or(pdf_available) pdf from r group by component),
    ranked as (select r.paper_id, r.pos, round(0.3 * case when cc > 0 then least(1.0, log10(cc + 1) / 3) else 0 end + 0.3 * case when publication_date is null and year is null then 0.5 when date_diff('day', coalesce(publication_date, make_date(year, 6, 15)), date '{AS_OF}') <= 365 then 1
      when date_diff('day', coalesce(publication_date, make_date(year, 6, 15)), date '{AS_OF}') >= 1825 then 0 else 1 - (date_diff('day', coalesce(publication_date, make_date(year, 6, 15)), date '{AS_OF}') - 365) / 1460.0 end
      + 0.2 * least(1.0, source_count / 3.0) + 0.2 * case when pdf then 1 else 0 end, 6)::double score from g join r on r.pos = g.base) select paper_id, score from ranked order by score desc, pos limit 50""")
def _(spark, sf):
    from inkwell.plans.scores import ranked

    papers = entity(spark, sf, "papers")
    merged = I.merge_groups(papers, I.components(I.paper_keys(papers)), _complete())
    return merged.withColumn("score", F.round(ranked(F.col("source_count")), 6)).orderBy(F.col("score").desc(), "pos").limit(50).select("paper_id", "score")
