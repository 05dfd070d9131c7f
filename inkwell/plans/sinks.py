"""Queries of sinks (B): rows are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.lineage import scratch
from inkwell.plans.ranking import FB, _feedback
from inkwell.plans.registry import query
from inkwell.sources import sinks as K
from inkwell.sources.entities import ctes, entity


@query("k6_audit_append", ctes("papers") + " select 'r1' as run_id, count(*) as n from papers where pos % 2 = 0 union all select 'r2', count(*) from papers where pos % 2 = 1")
def _(spark, sf):
    folder = scratch(spark)
    papers = entity(spark, sf, "papers")
    for i, run in enumerate(("r1", "r2")):
        K.append(papers.where(F.col("pos") % 2 == i).select(F.lit(run).alias("run_id"), "paper_id"), folder, "audit")
    return spark.read.parquet(f"{folder}/audit").groupBy("run_id").agg(F.count("*").alias("n"))


@query("k8_feedback_csv", FB + " select paper_id, rating, array_to_string(reasons, ',') as reasons from fb")
def _(spark, sf):
    path = f"{scratch(spark)}/feedback"
    K.feedback_csv(_feedback(spark, sf).select("paper_id", "rating", "reasons")).write.option("header", True).option("emptyValue", "").csv(path)
    return spark.read.schema("paper_id long, rating string, reasons string").option("header", True).csv(path).withColumn("reasons", F.coalesce("reasons", F.lit("")))


@query("k8_feedback_json", FB + " select paper_id, topic, rating from fb")
def _(spark, sf):
    path = f"{scratch(spark)}/feedback"
    _feedback(spark, sf).select("paper_id", "topic", "rating").write.json(path)
    return spark.read.schema("paper_id long, topic string, rating string").json(path)


@query("k9_sharegpt_export", ctes("turns") + " select conv_id::varchar as id, count(*) as n, sum(case when action = 'user' then 1 else 0 end)::bigint as human from turns group by conv_id")
def _(spark, sf):
    path = f"{scratch(spark)}/trajectories"
    whole = entity(spark, sf, "turns").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "action", "text"))).alias("turns"))
    whole.select(K.sharegpt(whole).alias("value")).write.text(path)
    back = spark.read.schema("id string, conversations array<struct<from:string,value:string>>").json(path)
    return back.select("id", F.size("conversations").cast("long").alias("n"), F.size(F.filter("conversations", lambda t: t["from"] == "human")).cast("long").alias("human"))


@query("k9_trajectory_csv", ctes("turns") + " select conv_id, substr(arg_min(text, turn), 1, 100) as question, printf('%.3f', count(*) / 10.0) as score, count(*) as n_turns from turns group by conv_id")
def _(spark, sf):
    t = entity(spark, sf, "turns").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), (F.count("*") / 10.0).alias("score"), F.count("*").alias("n_turns"))
    return K.trajectory_csv(t)


@query("k11_checkpoint", ctes("papers") + " select paper_id from papers where pos % 4 <> 0")
def _(spark, sf):
    folder = scratch(spark)
    papers = entity(spark, sf, "papers").select("pos", "paper_id")
    K.mark_done(spark, papers.where("pos % 4 = 0").select("paper_id"), folder, "run1")
    return K.pending(papers, folder, "run1", "paper_id").select("paper_id")


@query("k12_registry_save", ctes("papers") + " select paper_id, title from papers")
def _(spark, sf):
    folder = scratch(spark)
    papers = entity(spark, sf, "papers").select("paper_id", "title")
    for version in (papers.limit(0), papers):
        K.replace_table(version, folder, "registry")
    return K.current_table(spark, folder, "registry")
