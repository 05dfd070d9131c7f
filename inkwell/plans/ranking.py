"""Queries of feedback, preference learning and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import feedback as B
from inkwell.operators import trajectory as T
from inkwell.plans.registry import query
from inkwell.sources.entities import ctes, entity, table

FB = ctes("feedback") + ", fb as (select *, list_filter([case when k & 1 = 1 then 'novel' end, case when k & 2 = 2 then 'clear' end, case when k & 4 = 4 then 'useful' end], lambda x: x is not null) reasons from feedback)"


def _feedback(spark, sf):
    bit = lambda b, name: F.when(F.col("k").bitwiseAND(b) == b, name)
    reasons = F.filter(F.array(bit(1, "novel"), bit(2, "clear"), bit(4, "useful")), lambda x: x.isNotNull())
    return entity(spark, sf, "feedback").withColumn("reasons", reasons)


@query("p9_feedback_query", FB + " select paper_id from fb where topic = 't2' and list_has_any(reasons, ['novel', 'useful']) and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-02-25'")
def _(spark, sf):
    return B.matching(_feedback(spark, sf), topic="t2", any_reason=("novel", "useful"), start="2024-01-05", end="2024-02-25").select("paper_id")


@query("a7_ratings", FB + " select r as rating, count(rating) as n from (values ('thumbs_up'), ('thumbs_down'), ('neutral')) v(r) left join fb on rating = r group by r")
def _(spark, sf):
    return B.ratings(_feedback(spark, sf))


@query("a7_top_reasons", FB + " select reason, count(*) as n from (select unnest(reasons) reason from fb) group by reason order by n desc, reason limit 10")
def _(spark, sf):
    return B.top_reasons(_feedback(spark, sf), 10)


@query("a7_topic_reasons", FB + " select topic, reason, count(*) as n from (select coalesce(topic, '_uncategorized') topic, unnest(reasons) reason from fb) group by 1, 2 qualify row_number() over (partition by topic order by count(*) desc, reason) <= 2")
def _(spark, sf):
    return B.top_reasons(_feedback(spark, sf).withColumn("topic", F.coalesce("topic", F.lit("_uncategorized"))), 2, ["topic"])


@query("a7_a9_topics", FB + " select coalesce(topic, '_uncategorized') as topic, count(*) as total, count(*) filter (rating = 'thumbs_up') as thumbs_up, count(*) filter (rating = 'thumbs_down') as thumbs_down, count(*) filter (rating = 'neutral') as neutral, round(count(*) filter (rating = 'thumbs_up')::double / count(*), 6) as positive_ratio from fb group by 1")
def _(spark, sf):
    return B.by_topic(_feedback(spark, sf)).withColumn("positive_ratio", F.round("positive_ratio", 6))


@query("a8_trending", FB + " select reason, count(*) as n from (select unnest(reasons) reason from (select * from fb order by ts desc, event_id desc limit 50) where rating = 'thumbs_up') group by reason order by n desc, reason limit 5")
def _(spark, sf):
    return B.trending(_feedback(spark, sf))


@query("n17_submit_feedback", FB + " select paper_id, case when paper_id % 10 = 0 and paper_id % 20 = 0 then 'new' else topic end as topic, case when paper_id % 10 = 0 then 'thumbs_up' else rating end as rating, event_id as entry_id from fb")
def _(spark, sf):
    e = entity(spark, sf, "feedback").select("paper_id", F.col("event_id").alias("entry_id"), "topic", "rating", "ts")
    new = e.where("paper_id % 10 = 0").select("paper_id", F.lit(-1).cast("long").alias("entry_id"), F.when(F.col("paper_id") % 20 == 0, "new").alias("topic"), F.lit("thumbs_up").alias("rating"), "ts")
    return B.submit(e, new).select("paper_id", "topic", "rating", "entry_id")


@query("k10_archive", FB + " select case when row_number() over (order by ts desc, event_id desc) <= 100 then 'kept' else 'archived' end as part, event_id from fb")
def _(spark, sf):
    kept, rest = B.archive(entity(spark, sf, "feedback"), 100)
    return kept.select(F.lit("kept").alias("part"), "event_id").union(rest.select(F.lit("archived"), "event_id"))


_BETA = "select event_id % 500 as paper_id, count(*) filter (event_type = 'purchase') as ups, count(*) filter (event_type = 'error') as downs from events group by 1"


def _entries(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").otherwise("neutral")
    return table(spark, sf, "events").select((F.col("event_id") % 500).alias("paper_id"), kind.alias("rating"))


@query("r14_beta_preference", f"select paper_id, ups, downs, round((1 + ups)::double / (2 + ups + downs), 6) as preference from ({_BETA})")
def _(spark, sf):
    return B.beta_means(_entries(spark, sf)).withColumn("preference", F.round("preference", 6))


@query("r16_blend_rank", ctes("papers") + f", b as ({_BETA}) select papers.paper_id, round(0.3 * coalesce((1 + ups)::double / (2 + ups + downs), 0.5) + 0.7 * relevance, 6) as score from papers left join b on b.paper_id = pos order by score desc, pos limit 50")
def _(spark, sf):
    prefs = B.beta_means(_entries(spark, sf)).select(F.col("paper_id").alias("pos"), "preference")
    s = entity(spark, sf, "papers").join(prefs, "pos", "left").withColumn("score", F.round(B.blend(F.col("preference"), F.col("relevance")), 6))
    return s.orderBy(F.col("score").desc(), "pos").limit(50).select("paper_id", "score")


@query("r15_ridge_preference")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    model = B.RidgeModel.fit(e.withColumn("y", F.col("label") % 2), "embedding", "y")
    return e.select("vec_id", F.round(model.predict(F.col("embedding")), 5).alias("preference"))


@query("r17_thompson")
def _(spark, sf):
    return B.thompson(B.beta_means(_entries(spark, sf)).select("paper_id", "ups", "downs"), 20, seed=7).select("paper_id", "ups", "downs")


TU = ctes("turns")


@query("w9_action_grams", TU + " select conv_id, turn, action || ' > ' || b || ' > ' || c as gram from (select conv_id, turn, action, lead(action, 1) over w b, lead(action, 2) over w c from turns window w as (partition by conv_id order by turn)) where c is not null")
def _(spark, sf):
    return T.action_grams(entity(spark, sf, "turns"))


@query("a18_top_grams", TU + " select action || ' > ' || b || ' > ' || c as gram, count(*) as n from (select conv_id, turn, action, lead(action, 1) over w b, lead(action, 2) over w c from turns window w as (partition by conv_id order by turn)) where c is not null group by 1 order by n desc, gram limit 5")
def _(spark, sf):
    return T.top_grams(entity(spark, sf, "turns"))


@query("a18_top_terms", TU + r" select term, count(*) as n from (select unnest(string_split_regex(lower(text), '\s+')) term from turns where action = 'user') where length(term) > 3 group by term order by n desc, term limit 10")
def _(spark, sf):
    return T.top_terms(entity(spark, sf, "turns"))


_SCORE = "round(case when a = 1 then 0.4 else 0 end + case when n between 3 and 15 then 0.2 when n > 0 then 0.1 else 0 end + case when k >= 3 then 0.2 when k >= 1 then 0.1 else 0 end + 0.2 * a, 4)::double"
_SUM = TU + f", s as (select conv_id, count(*) n, max(case when action = 'assistant' then 1 else 0 end) a, count(distinct action) k, sum(tokens) tokens from turns group by 1), q as (select *, {_SCORE} score from s)"


def _scored(spark, sf):
    s = T.summary(entity(spark, sf, "turns"))
    return s.withColumn("score", T.quality(F.col("answered") == 1, F.col("n_turns"), F.col("n_actions"), F.col("answered")))


@query("r19_trajectory_quality", _SUM + " select conv_id, score from q")
def _(spark, sf):
    return _scored(spark, sf).select("conv_id", "score")


@query("a17_trajectory_stats", _SUM + " select count(*) as n, sum(a)::bigint as with_answer, round(avg(score), 6) as avg_score, round(avg(n), 6) as avg_turns, sum(tokens)::bigint as tokens, count(*) filter (score >= 0.8) as high, count(*) filter (score >= 0.5 and score < 0.8) as medium, count(*) filter (score < 0.5) as low from q")
def _(spark, sf):
    return T.statistics(_scored(spark, sf)).withColumn("with_answer", F.col("with_answer").cast("long"))


@query("p10_trajectory_filter", _SUM + " select conv_id from q where n >= 3 and a = 1 and score >= 0.5")
def _(spark, sf):
    return T.worthwhile(_scored(spark, sf)).select("conv_id")


_IDEAL = ("system", "user", "assistant", "user", "assistant")


def _lcs() -> str:
    """A row of the table of common subsequences for each turn, one column an action of the ideal."""
    names, steps = "abcde", []
    for j, (c, x) in enumerate(zip(names, _IDEAL, strict=True)):
        before, left = (f"{names[j - 1]}0", names[j - 1]) if j else ("0", "0")
        steps.append(f"case when action = '{x}' then {before} + 1 else greatest({c}0, {left}) end as {c}")
    cols = ", ".join(f"{c} as {c}0" for c in names)
    return f""", q as materialized (select conv_id, action, row_number() over (partition by conv_id order by turn, action) n from turns),
    r as (select distinct conv_id, 0::bigint n, {", ".join(f"0 as {c}" for c in names)} from turns union all select conv_id, n, {", ".join(steps)} from (select q.conv_id, q.n, q.action, {cols} from r join q on q.conv_id = r.conv_id and q.n = r.n + 1))
    select conv_id, round(arg_max(e, n)::double / greatest(max(n), {len(_IDEAL)}), 6) as alignment from r group by conv_id"""


@query("r18_lcs_alignment", TU.replace("with ", "with recursive ", 1) + _lcs())
def _(spark, sf):
    acts = entity(spark, sf, "turns").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "action"))), lambda x: x["action"]).alias("a"))
    ideal = F.array(*map(F.lit, _IDEAL))
    return acts.select("conv_id", F.round(T.alignment(F.col("a"), ideal), 6).alias("alignment"))


@query("r22_contextual_tips", _SUM + ", m as (select avg(n) t, avg(a) w from q) select tip, confidence from (select 'Use fewer turns' as tip, 0.8::double as confidence, t > 4 as ok from m union all select 'Answer more often', 0.75, w < 1.1 from m) where ok")
def _(spark, sf):
    insights = _scored(spark, sf).agg(F.avg("n_turns").alias("t"), F.avg("answered").alias("w"))
    rules = [("t", "t > 4", 0.8, "Use fewer turns"), ("w", "w < 1.1", 0.75, "Answer more often"), ("w", "w < 2", 0.5, "Not sure enough")]
    return T.tips(insights, rules)
