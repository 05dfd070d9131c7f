"""Queries of retrieval (J) over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores as S
from inkwell.functions import text as T
from inkwell.operators import retrieval as R
from inkwell.plans.registry import query
from inkwell.sources.entities import table

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: The queries of searches are the rows whose id is divisible by 50: their titles and their vectors, against all rows.
_Q = "q(query_id, t) as (select doc_id, split_part(text, chr(10), 1) from documents where doc_id % 50 = 0)"
_TOK = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '' and w not in (" + _STOP + "))"
_BM25 = f"""{_Q}, d as (select doc_id id, {_TOK.format("text")} t from documents), st as (select count(*) n, avg(len(t)) al from d),
    a as (select query_id, unnest(list_distinct({_TOK.format("t")})) term from q), tf as (select id, len(d.t) l, u.term, count(*) tf from d, (select unnest(d.t) term) u where u.term in (select term from a) group by all),
    df as (select term, count(*) df from tf group by 1),
    s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 9) score from a join tf using (term) join df using (term), st group by 1, 2),
    sparse as (select *, row_number() over (partition by query_id order by score desc, id) rank from s where score > 0)"""
_DENSE = "v as (select vec_id id, embedding::double[] e from embeddings), dense as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) rank from (select q.id as query_id, v.id, round(list_cosine_similarity(v.e, q.e), 6) score from v, v q where q.id % 50 = 0))"


def _asked(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _sparse(spark, sf, k):
    return R.bm25(_docs(spark, sf), _asked(spark, sf), k)


def _dense(spark, sf, k, excluded=None):
    v = _vectors(spark, sf)
    return R.dense_top(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), k, excluded)


@query("r1_bm25", "with " + _BM25 + " select query_id, id, round(score, 5) as score, rank::int as rank from sparse where rank <= 10")
def _(spark, sf):
    return _sparse(spark, sf, 10).withColumn("score", F.round("score", 5))


@query("r2_dense_top", "with " + _DENSE + " select query_id, id, round(score, 4) as score from dense where rank <= 10")
def _(spark, sf):
    return _dense(spark, sf, 10).select("query_id", "id", F.round("score", 4).alias("score"))


@query("o14_dense_excluding", "with " + _DENSE + " select query_id, id, round(score, 4) as score from dense where id <> query_id qualify row_number() over (partition by query_id order by dense.score desc, id) <= 10")
def _(spark, sf):
    v = _vectors(spark, sf)
    excluded = v.where("id % 50 = 0").select("id", F.col("id").alias("query_id"))
    return _dense(spark, sf, 10, excluded).select("query_id", "id", F.round("score", 4).alias("score"))


@query("r3_w5_hybrid_fusion", "with " + _BM25 + ", " + _DENSE + ", f as (select query_id, id, least(1.0, sum(s)) score from (select query_id, id, 0.7::double / (60 + rank) s from dense where rank <= 30 union all select query_id, id, 0.3::double / (60 + rank) from sparse where rank <= 30) group by 1, 2) select query_id, id, round(score, 7) as score from f qualify row_number() over (partition by query_id order by round(f.score, 9) desc, id) <= 10")
def _(spark, sf):
    return R.fuse(_dense(spark, sf, 30), _sparse(spark, sf, 30), 10).select("query_id", "id", F.round("score", 7).alias("score"))


@query("r7_w11_find", r"""with s as (select doc_id id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents),
    e as (select id, s, unnest(s) x, generate_subscripts(s, 1) - 1 i from s), m as (select *, row_number() over (partition by id order by i) r from e where regexp_matches(x, '(?i)andhe|ungbe'))
    select id, i::int as sentence_no, regexp_extract(x, '(?i)(andhe|ungbe)') as matched, array_to_string(s[greatest(i, 1):i + 2], ' ') as context, strpos(x, regexp_extract(x, '(?i)(andhe|ungbe)')) - 1 as position from m where r <= 3""")
def _(spark, sf):
    return R.find(_docs(spark, sf), "(?:andhe|ungbe)", 3).withColumn("position", F.col("position").cast("long"))


@query("r8_open_document", "select doc_id, text as content from (select doc_id, string_agg(p, chr(10) || chr(10) order by i) as text from (select doc_id, unnest(w) p, generate_subscripts(w, 1) i from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') w from documents)) group by doc_id)")
def _(spark, sf):
    parts = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("idx", "content")).withColumn("tokens", T.token_estimate(F.col("content")))
    return R.open_document(chunks).select("doc_id", "content")


_LONGW = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{4,}}'))"


@query("r9_validate_claims", f"""with c as (select doc_id, split_part(text, chr(10), 1) claim, text from documents), o as (select c.doc_id, {_LONGW.format("c.claim")} w, d.text from c join documents d on d.doc_id = c.doc_id + c.doc_id % 2)
    select doc_id as claim_id, round(case when len(w) > 0 then len(list_filter(w, lambda x: contains(lower(text), x)))::double / len(w) else 0 end, 6) as support, len(w) > 0 and len(list_filter(w, lambda x: contains(lower(text), x)))::double / len(w) >= 0.7 as found from o""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    claims = docs.select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") + F.col("doc_id") % 2).alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("claim"))
    return R.validate_claims(claims, _docs(spark, sf)).select("claim_id", "support", "found")


@query("r24_cited_claims", "select doc_id as answer_id, 'd' || doc_id::varchar as id, trim(regexp_replace(split_part(text, chr(10), 1), '[\\[\\]]', '', 'g')) as claim, doc_id::varchar || '-0' as claim_id from documents where trim(regexp_replace(split_part(text, chr(10), 1), '[\\[\\]]', '', 'g')) <> ''")
def _(spark, sf):
    claim = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"[\[\]]", "")
    answers = table(spark, sf, "documents").where(F.trim(claim) != "").select(F.col("doc_id").cast("string").alias("answer_id"), F.concat(F.lit("As said [d"), F.col("doc_id").cast("string"), F.lit(": "), claim, F.lit("].")).alias("answer"))
    return R.cited_claims(answers).select(F.col("answer_id").cast("long").alias("answer_id"), "id", "claim", "claim_id")


@query("r10_r11_similarity_bands", "with p as (select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(least(1.0, greatest(0.0, (c + 1) / 2)), 6) as similarity, array_to_string(list_filter([case when (c + 1) / 2 >= 0.9 then 'nearly identical' end, case when (c + 1) / 2 >= 0.7 then 'closely related' end, case when (c + 1) / 2 >= 0.5 then 'related' end], lambda x: x is not null), ',') as labels from p")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").withColumn("c", F.round(S.cosine(F.col("embedding"), F.col("other")), 5))
    return p.select("vec_id", F.round(R.rescaled(F.col("c")), 6).alias("similarity"), F.array_join(R.band_labels(R.rescaled(F.col("c"))), ",").alias("labels"))


@query("a21_similar_to_liked", "with l as (select vec_id id, embedding::double[] e from embeddings where vec_id % 25 = 0), c as (select vec_id id, embedding::double[] e from embeddings where vec_id % 25 <> 0) select c.id as candidate, round(avg((list_cosine_similarity(c.e, l.e) + 1) / 2), 5) as score from c, l group by 1")
def _(spark, sf):
    v = _vectors(spark, sf)
    return R.similar_to_liked(v, v.where("id % 25 = 0").select("id")).withColumn("score", F.round("score", 5))


_CHUNKS = r"""with recursive d as (select doc_id id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') p from documents),
    c as (select id, p, list_transform(p, lambda x: greatest(length(x) // 4, len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')))) n from d where len(p) > 0),
    s as materialized (select id, p, len(p) cnt, list_transform(range(0, len(p) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)) sums from c),
    r as (select id, 0 idx, 0::bigint a, greatest(1, len(list_filter(sums, lambda x: x <= 512)) - 1) b from s
      union all select id, idx + 1, a2, greatest(b + 1, len(list_filter(sums, lambda x: x <= sums[a2 + 1] + 512)) - 1)
      from (select r.id, idx, b, sums, greatest(a, least(b - 1, len(list_filter(sums, lambda x: x < sums[b + 1] - 64)))) a2 from r join s on s.id = r.id where b < cnt)),
    o as (select r.id, idx, b = cnt as final, sums[b + 1] - sums[a + 1] as n, array_to_string(p[a + 1:b], chr(10) || chr(10)) content from r join s on s.id = r.id)
    select id, idx::int as idx, case when final then greatest(length(content) // 4, len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> ''))) else n end::bigint as tokens, sha256(content) as checksum from o"""


@query("w10_chunks", _CHUNKS)
def _(spark, sf):
    return R.chunk(_docs(spark, sf).withColumn("text", F.regexp_replace("text", r"\n", "\n\n"))).select("id", "idx", "tokens", "checksum")


@query("f_str16_parse_sections", r"""with p as (select doc_id, doc_id::varchar n from documents) select doc_id as id, s as section, h as header, c as content from (
    select doc_id, 'other' s, '' h, 'intro ' || n c from p union all select doc_id, 'methods', 'Methods', 'how ' || n from p union all select doc_id, 'other', 'Odd', 'what' from p)""")
def _(spark, sf):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("intro "), n, F.lit("\n## Methods\n\nhow "), n, F.lit("\n# Empty\n\n### Odd\nwhat\n"))
    return R.parse_sections(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))).select("id", "section", "header", "content")


@query("r5_changed_documents", "select doc_id as id from documents where doc_id % 3 <> 0 or doc_id % 6 = 0")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))
    ingested = docs.where("id % 3 = 0").withColumn("checksum", F.when(F.col("id") % 6 == 0, "old").otherwise(F.col("checksum")))
    return R.changed(docs, ingested).select("id")


@query("r6_freshness", "select 'stale' as state, count(*) as n_changed from documents where doc_id % 2 = 1")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))
    return R.freshness(docs, docs.where("id % 2 = 0"))


@query("n18_corpus_remove", "select count(*) as n from documents where doc_id % 10 <> 0")
def _(spark, sf):
    docs = _docs(spark, sf)
    return docs.join(docs.where("id % 10 = 0").select("id"), "id", "left_anti").agg(F.count("*").alias("n"))


@query("a16_corpus_stats", "select source as section, count(*) as chunks, sum(greatest(floor(length(text) / 4.0)::bigint, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))))::bigint as tokens from documents group by 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("section")).agg(F.count("*").alias("chunks"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))



