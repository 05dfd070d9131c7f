"""Queries of the scalar functions (group K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores as S
from inkwell.functions import text as T
from inkwell.plans.registry import query
from inkwell.sources.entities import ctes, entity, table

P = ctes("papers")
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("f_str1_title_key", P + r" select paper_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as title_key from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", T.title_key(F.col("title")).alias("title_key"))


@query("f_str2_title_key_unicode", P + r" select paper_id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as title_key from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", T.title_key_unicode(F.col("title")).alias("title_key"))


@query("f_str3_title_key_loose", P + r""" select paper_id, translate(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), '.,;:!?()-"''', '') as title_key from papers""")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", T.title_key_loose(F.col("title")).alias("title_key"))


_GRAMS = "case when length(k) < 3 then [k] else list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) end"


@query(
    "f_str4_title_similarity",
    P + rf""", k as (select pos, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as k from papers),
    p as (select a.pos, a.k x, b.k y, {_GRAMS.replace("(k", "(a.k").replace("[k]", "[a.k]")} g, {_GRAMS.replace("(k", "(b.k").replace("[k]", "[b.k]")} h from k a join k b on b.pos = a.pos + 1)
    select pos, round(case when x = '' or y = '' then 0.0 when x = y then 1.0 else len(list_intersect(g, h))::double / len(list_distinct(list_concat(g, h))) end, 6) as similarity from p""",
)
def _(spark, sf):
    k = entity(spark, sf, "papers").select("pos", T.title_key(F.col("title")).alias("k"))
    pairs = k.join(k.select((F.col("pos") - 1).alias("pos"), F.col("k").alias("y")), "pos")
    return pairs.select("pos", F.round(T.title_similarity(F.col("k"), F.col("y")), 6).alias("similarity"))


@query("f_str5_sequence_ratio")
def _(spark, sf):
    from inkwell.operators.identity import sequence_ratio

    k = entity(spark, sf, "papers").select("pos", T.title_key_unicode(F.col("title")).alias("x"))
    pairs = k.join(k.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("y")), "pos")
    return pairs.select("pos", F.round(sequence_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


@query(
    "f_str6_topic_slug",
    P + r""", s as (select paper_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\s+and\s+', '-', 'g'), '\s+or\s+', '-', 'g'), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') s from papers)
    select paper_id, case when regexp_replace(substr(s, 1, 64), '-+$', '') = '' then 'unknown-topic' else regexp_replace(substr(s, 1, 64), '-+$', '') end as slug from s""",
)
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", T.slug(F.col("title")).alias("slug"))


_WORDS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> '')"


@query(
    "f_str7_word_overlap",
    P + rf""", w as (select paper_id, ['the', 'of', 'die', 'and', 'que', 'le'] q, list_distinct({_WORDS.format("title || ' ' || coalesce(abstract, '')")}) t from papers)
    select paper_id, round(case when len(t) = 0 then 0.0 else len(list_intersect(q, t))::double / len(list_distinct(list_concat(q, t))) end, 6) as overlap from w""",
)
def _(spark, sf):
    text = F.concat_ws(" ", "title", F.coalesce("abstract", F.lit("")))
    return entity(spark, sf, "papers").select("paper_id", F.round(T.word_overlap(F.lit("the of die and que le"), text), 6).alias("overlap"))


@query(
    "f_str8_index_tokens",
    P + rf""", t as (select paper_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(abstract, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '' and w not in ({_STOP})) t from papers)
    select paper_id, len(t) as n_tokens, array_to_string(t[1:5], ' ') as first_tokens from t""",
)
def _(spark, sf):
    t = entity(spark, sf, "papers").select("paper_id", T.index_tokens(F.col("abstract")).alias("t"))
    return t.select("paper_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


@query("f_str9_token_estimate", rf"select doc_id, greatest(floor(length(text) / 4.0)::bigint, len({_WORDS.format('text')})) as tokens from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("f_str10_edge_key", ctes("cites") + " select edge_id, substr(sha256(source_id::varchar || '|' || target_id::varchar), 1, 32) as edge_key from cites")
def _(spark, sf):
    return entity(spark, sf, "cites").select("edge_id", T.edge_key(F.col("source_id").cast("string"), F.col("target_id").cast("string")).alias("edge_key"))


@query(
    "f_str11_target_hash",
    """with t as (select p_partkey // 8 as g, lower(trim(p_type)) n, lower(trim(p_name)) d, p_size % 2 = 0 r, p_partkey from part)
    select g, 'sha256:' || sha256('[' || string_agg('{"description":"' || d || '","name":"' || n || '","output_format":"text","required":' || case when r then 'true' else 'false' end || '}', ',' order by n, p_partkey) || ']') as target_hash from t group by g""",
)
def _(spark, sf):
    from inkwell.operators.identity import target_hash

    t = table(spark, sf, "part").select(F.expr("p_partkey div 8").alias("g"), F.col("p_type").alias("name"), F.col("p_name").alias("description"), F.lit("text").alias("output_format"), (F.col("p_size") % 2 == 0).alias("required"), F.col("p_partkey").alias("pos"))
    return target_hash(t, ["g"])


@query(
    "f_str12_venue_key",
    "select n_nationkey, trim(regexp_replace(regexp_replace(lower('Proceedings of the ' || n_name || ' Conference on ' || n_name || ' 2024!'), '[0-9]+|[^a-z_ ]|\\b(proceedings|conference|of|the|on)\\b', '', 'g'), ' +', ' ', 'g')) as venue_key from nation",
)
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.venue_key(F.concat(F.lit("Proceedings of the "), "n_name", F.lit(" Conference on "), "n_name", F.lit(" 2024!"))).alias("venue_key"))


#: Scores of the derived venues; "src1" is part of "src10", which the substring rules must handle.
VENUES = {"src1": 0.9, "src2": 0.7, "src10": 0.4, "src15": 1.0, "rc3": 0.6}


def _first(names) -> str:
    return " ".join(f"when contains(lower(trim(venue)), '{k}') then {v}" for k, v in names)


@query("f_str13_venue_score", P + f" select paper_id, case when venue is null then 0.5 {_first(sorted(VENUES.items(), key=lambda x: -len(x[0])))} else 0.5 end::double as longest, case when venue is null then 0.5 {_first(VENUES.items())} else 0.5 end::double as first_found from papers")
def _(spark, sf):
    v = F.lower(F.trim(F.coalesce("venue", F.lit(""))))
    return entity(spark, sf, "papers").select("paper_id", S.venue_longest(v, VENUES, 0.5).alias("longest"), S.venue_first(F.col("venue"), VENUES, 0.5).alias("first_found"))


@query(
    "f_str14_clean_untrusted",
    P + r""", s as (select paper_id, regexp_replace(coalesce(abstract, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') s from papers)
    select paper_id, case when length(s) > 100 then substr(s, 1, 97) || '...' else s end as cleaned from s""",
)
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", T.clean_untrusted(F.col("abstract"), 100).alias("cleaned"))


@query(
    "f_str15_short_summary",
    P + r""", s as (select paper_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(abstract, ''), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\s+', ' ', 'g')) s from papers),
    h as (select paper_id, s, substr(s, 1, 120) h, case when contains(substr(s, 1, 120), ' ') then 119 - (strpos(reverse(substr(s, 1, 120)), ' ') - 1) else -1 end sp from s)
    select paper_id, case when length(s) <= 120 then s else regexp_replace(case when sp > 60 then substr(h, 1, sp) else h end, '[.,;:]+$', '') || '...' end as summary from h""",
)
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", T.short_summary(F.col("abstract"), 120).alias("summary"))


@query(
    "f_str16_section_kind",
    """with h as (select * from (values ('Abstract'), ('Summary'), ('Future Work'), ('METHODS'), ('Method'), ('Results '), ('Analysis'), ('Bibliography'), ('Overview'), ('Other words'), ('Experimental Setup')) t(header))
    select header, case when regexp_matches(lower(trim(header)), '^(abstract|summary)$') then 'abstract' when regexp_matches(lower(trim(header)), '^(introduction|background|overview)$') then 'introduction'
      when regexp_matches(lower(trim(header)), '^(methods?|methodology|approach|experimental setup)$') then 'methods' when regexp_matches(lower(trim(header)), '^(results?|findings|experiments?)$') then 'results'
      when regexp_matches(lower(trim(header)), '^(discussion|analysis)$') then 'discussion' when regexp_matches(lower(trim(header)), '^(conclusions?|future work)$') then 'conclusion'
      when regexp_matches(lower(trim(header)), '^(references?|bibliography|citations?)$') then 'references' else 'other' end as kind from h""",
)
def _(spark, sf):
    names = ["Abstract", "Summary", "Future Work", "METHODS", "Method", "Results ", "Analysis", "Bibliography", "Overview", "Other words", "Experimental Setup"]
    return spark.createDataFrame([(n,) for n in names], "header string").select("header", T.section_kind(F.col("header")).alias("kind"))


@query("f_str17_author_names", P + " select paper_id, array_to_string(list_transform(range(1, n_authors + 1), lambda i: 'a' || i::varchar), ', ') as authors from papers")
def _(spark, sf):
    made = F.when(F.col("n_authors") > 0, F.transform(F.sequence(F.lit(1), F.col("n_authors")), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    return entity(spark, sf, "papers").select("paper_id", F.array_join(T.author_names(made), ", ").alias("authors"))


_CODE, _TABLES = "len(regexp_extract_all(text, '```\\w*\\n'))", "len(regexp_extract_all(text, '\\|[\\s:|-]+\\|'))"


@query(
    "f_txt1_extraction_quality",
    rf"""with m as (select doc_id, length(text) n, length(text) / (1.0e0 + doc_id % 3) pp, (len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+')) + len(regexp_extract_all(text, '(?m)^\s*[-*+]\s+'))) / greatest(1.0, length(text) / 1000.0) st, {_CODE} c, {_TABLES} t from documents)
    select doc_id, round(case when n < 100 then 0.0 else 0.40 * case when pp between 500 and 2000 then 1.0 when pp < 100 then 0.0 else greatest(0.0, 1.0 - abs(pp - 1250) / 2500) end
      + 0.30 * case when st between 5 and 15 then 1.0 else greatest(0.0, 1.0 - abs(st - 10) / 20) end + 0.15 * case when c = 0 then 0.5 else least(1.0, 0.5 + c / 5.0) end + 0.15 * case when t = 0 then 0.5 else least(1.0, 0.5 + t / 3.0) end end, 4)::double as quality from m""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.extraction_quality(F.col("text"), 1.0 + F.col("doc_id") % 3), 4).alias("quality"))


@query(
    "f_txt2_code_like",
    r"""with l as (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) l from documents)
    select doc_id, (list_sum(list_transform(l, lambda x: regexp_matches(x, '^(?:    |\t)')::int + regexp_matches(x, '[{};]|def |class |import ')::int)) > len(l) * 0.5) and len(l) > 1 as code_like from l""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.code_like(F.col("text")).alias("code_like"))


@query(
    "f_math1_citation_scores",
    P + """ select paper_id, round(case when citation_count > 0 then least(1.0, log10(citation_count + 1) / 3 + case when influential > 0 then least(0.1, influential * 0.01) else 0 end) else 0 end, 6)::double as log10_bonus,
      round(case when citation_count > 0 then least(1.0, log10(citation_count + 1) / 3) else 0 end, 6)::double as log10_next, round(case when citation_count > 0 then least(1.0, log10(citation_count) / 3) else 0 end, 6)::double as log10_plain,
      round(least(1.0, ln(1 + citation_count) / 10), 6)::double as log1p_plain,
      round(case when citation_count > 0 then least(1.0, ln(1 + citation_count) / 10 + case when influential is null then 0.05 when influential > 0 then least(0.1, influential * 0.01) else 0 end) else 0 end, 6)::double as log1p_bonus from papers""",
)
def _(spark, sf):
    c, i = F.col("citation_count"), F.col("influential")
    made = {"log10_bonus": S.citation_log10(c, i), "log10_next": S.citation_log10(c), "log10_plain": S.citation_log10_plain(c), "log1p_plain": S.citation_log1p(c), "log1p_bonus": S.citation_log1p_bonus(c, i)}
    return entity(spark, sf, "papers").select("paper_id", *(F.round(x, 6).alias(n) for n, x in made.items()))


@query(
    "f_date_recency_curves",
    P + """, a as (select *, date_diff('day', publication_date, date '2024-01-30') age, 2024 - year y, date_diff('day', coalesce(publication_date, make_date(year, 6, 15)), date '2024-01-30') age2 from papers)
    select paper_id, (case when age is null or age < 0 then 0.5 when age < 365 then 1 when age < 730 then 0.75 when age < 1825 then 0.5 else 0.25 end)::double steps,
      round(case when year is null then 0.5 else greatest(0.1, 1 / (1 + 0.2 * greatest(0, y))) end, 6)::double decay, round(case when y is null or y < 0 then 0.5 else greatest(0, 1 - y / 10.0) end, 6)::double ten_years,
      round(case when age2 is null then 0.5 when age2 <= 365 then 1 when age2 >= 1825 then 0 else 1 - (age2 - 365) / 1460.0 end, 6)::double five_years from a""",
)
def _(spark, sf):
    day, p, y = F.lit("2024-01-30").cast("date"), F.col("publication_date"), F.col("year")
    made = {"steps": S.recency_steps(p, day), "decay": S.recency_decay(y, 2024), "ten_years": S.recency_ten_years(y, 2024), "five_years": S.recency_five_years(p, y, day)}
    return entity(spark, sf, "papers").select("paper_id", *(F.round(x, 6).alias(n) for n, x in made.items()))


@query("f_math9_engagement", P + " select paper_id, round(case when upvotes <= 0 then 0.5 else least(1.0, ln(1 + upvotes) / 7) end, 6)::double neutral, round(case when upvotes <= 0 then 0 else least(1.0, ln(1 + upvotes) / 7) end, 6)::double zero from papers")
def _(spark, sf):
    return entity(spark, sf, "papers").select("paper_id", F.round(S.engagement(F.col("upvotes")), 6).alias("neutral"), F.round(S.engagement(F.col("upvotes"), 0.0), 6).alias("zero"))


_DONE = "case when {a} then 0.3 else 0 end + case when n_authors > 0 then 0.2 else 0 end + case when venue <> '' then 0.2 else 0 end + case when pdf_available then 0.2 else 0 end + case when doi <> '' then 0.1 else 0 end"


@query(
    "f_math8_completeness",
    P + f""" select paper_id, round(case when length(trim(abstract)) > 0 then 0.5 else 0 end + case when n_authors > 0 then 0.3 else 0 end + case when doi <> '' then 0.2 else 0 end, 6)::double legacy,
      round({_DONE.format(a="length(trim(abstract)) >= 50")}, 6)::double five, round({_DONE.format(a="length(abstract) > 50")}, 6)::double five_strict from papers""",
)
def _(spark, sf):
    c = F.col
    five = lambda strict: S.completeness_five(c("abstract"), c("n_authors"), c("venue"), c("pdf_available"), c("doi"), strict)
    return entity(spark, sf, "papers").select("paper_id", F.round(S.completeness_legacy(c("abstract"), c("n_authors"), c("doi")), 6).alias("legacy"), F.round(five(False), 6).alias("five"), F.round(five(True), 6).alias("five_strict"))


@query("f_math10_llm_cost", ctes("costs") + " select event_id, round(tokens / 1e6 * case provider when 'purchase' then 3.0e0 when 'view' then 0.5e0 else 1.0e0 end + tokens / 4e6 * case provider when 'purchase' then 15.0e0 when 'view' then 1.5e0 else 4.0e0 end, 9)::double as cost from costs")
def _(spark, sf):
    return entity(spark, sf, "costs").select("event_id", F.round(S.llm_cost(F.col("tokens"), F.col("tokens") / 4, F.col("provider"), {"purchase": (3.0, 15.0), "view": (0.5, 1.5)}, (1.0, 4.0)), 9).alias("cost"))


@query(
    "f_vec1_cosine",
    "select a.vec_id, round(case when sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) > 0 then list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) else 0 end, 5) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("f_arr1_inverted_abstract", "with w as (select doc_id, string_split(text, ' ') w from documents) select doc_id, array_to_string(w, ' ') as abstract from w")
def _(spark, sf):
    from inkwell.sources.mappers import from_inverted_index, inverted_index

    # word -> positions, as the provider sends it
    return inverted_index(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", from_inverted_index(F.col("index")).alias("abstract"))


@query("f_arr2_topic_membership", ctes("feedback") + " select paper_id, coalesce(topic in ('t1', 't2'), false) as any_of, not coalesce(topic in ('t3', 't4'), false) as none_of from feedback")
def _(spark, sf):
    return entity(spark, sf, "feedback").select("paper_id", F.coalesce(F.arrays_overlap(F.array("topic"), F.array(F.lit("t1"), F.lit("t2"))), F.lit(False)).alias("any_of"), (~F.coalesce(F.arrays_overlap(F.array("topic"), F.array(F.lit("t3"), F.lit("t4"))), F.lit(False))).alias("none_of"))


@query("f_map1_property_merge", ctes("nodes") + " select node_id, (node_id % 5)::varchar as a, case when node_id % 2 = 0 then 'new' else 'old' end as b from nodes")
def _(spark, sf):
    from inkwell.operators.store import merge_properties

    old, new = F.create_map(F.lit("a"), (F.col("node_id") % 5).cast("string"), F.lit("b"), F.lit("old")), F.when(F.col("node_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = entity(spark, sf, "nodes").select("node_id", merge_properties(old, new).alias("m"))
    return merged.select("node_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("f_json3_json_property", ctes("nodes") + " select node_id, json_extract_string(properties, '$.lang') as lang, try_cast(json_extract_string(properties, '$.citation_count') as int) as n from nodes")
def _(spark, sf):
    return entity(spark, sf, "nodes").select("node_id", F.get_json_object("properties", "$.lang").alias("lang"), F.expr("try_cast(get_json_object(properties, '$.citation_count') as int)").alias("n"))


@query("f_json2_last_json_object", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(spark, sf):
    from inkwell.functions.json_text import last_object

    said = F.concat(F.lit("I think {maybe} so: "), F.col("props"), F.lit(" and done"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(last_object(said), "$.k").alias("k"))


@query("f_json1_llm_response", """with e as (select event_id, event_id % 4 m from events)
    select event_id, 'title' as target, true as success, 'T' || event_id::varchar as value from e where m <> 3 union all select event_id, 'year', m <> 2, case when m <> 2 then '2024' else null end from e where m <> 3
    union all select event_id, 'title', false, null from e where m = 3 union all select event_id, 'year', false, null from e where m = 3""")
def _(spark, sf):
    from inkwell.functions.json_text import parse_extractions

    m, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    title = F.concat(F.lit('{"target_name": "title", "success": true, "content": "T'), i, F.lit('"}'))
    year = F.when(m == 2, F.lit('{"target_name": "unknown", "success": true, "content": "x"}')).otherwise(F.lit('{"target_name": "year", "success": true, "content": "2024"}'))
    said = F.when(m == 3, "no json").otherwise(F.concat(F.lit('```json\n{"extractions": ['), title, F.lit(", "), year, F.lit("]}\n```")))
    return parse_extractions(table(spark, sf, "events").select("event_id", said.alias("said")), "event_id", "said", {"title": True, "year": True})


@query("f_date5_timeframe", """with t as (select * from (values ('48h'), ('7d'), ('30d')) v(recent)) select recent, (timestamp '2024-01-30 00:00:00' - case when recent like '%h' then to_hours(replace(recent, 'h', '')::int) else to_days(replace(recent, 'd', '')::int) end)::varchar as since from t""")
def _(spark, sf):
    from inkwell.functions.time import since

    rows = spark.createDataFrame([("48h",), ("7d",), ("30d",)], "recent string")
    out = F.lit(None).cast("timestamp")
    for r in ("48h", "7d", "30d"):
        out = F.when(F.col("recent") == r, since(r, F.lit("2024-01-30").cast("timestamp"))).otherwise(out)
    return rows.select("recent", F.date_format(out, "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("f_date6_backfill_window", "with s as (select o_orderkey, o_orderdate::date c, (o_orderdate::date - 20) created from orders) select o_orderkey, greatest(c - 7, created, date '2024-01-30' - 3650)::varchar as window_start, c::varchar as window_end from s")
def _(spark, sf):
    from inkwell.functions.time import backfill_window

    s = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("c"))
    start, end = backfill_window(F.col("c"), F.date_sub("c", 20), F.lit("2024-01-30").cast("date"), 3650)
    return s.select("o_orderkey", start.cast("string").alias("window_start"), end.cast("string").alias("window_end"))
