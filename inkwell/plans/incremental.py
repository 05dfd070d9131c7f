"""Queries of incremental processing (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.lineage import scratch
from inkwell.operators.reports import registry_hash
from inkwell.plans.registry import query
from inkwell.sources.entities import AS_OF, ctes, entity, table
from inkwell.streaming import incremental as M


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # The stream reads a folder; only the events of the benchmark's folder are in it.
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("m1_m2_poll_stream", "select user_id, arg_min(event_id, (ts, event_id)) as event_id from events group by user_id")
def _(spark, sf):
    base = scratch(spark)
    return M.poll(spark, _stream(spark, sf), f"{base}/registry", f"{base}/state", "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("m3_single_source", "select user_id, arg_min(event_id, (ts, event_id)) as event_id from events where event_type = 'purchase' group by user_id")
def _(spark, sf):
    base = scratch(spark)
    return M.poll(spark, _stream(spark, sf).where("event_type = 'purchase'"), f"{base}/registry", f"{base}/state", "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("m5_windowed_stream", "select event_type, time_bucket(interval 6 hours, ts)::varchar as window_start, count(*) as n from events group by all")
def _(spark, sf):
    base = scratch(spark)
    out = M.windowed(_stream(spark, sf), "1 hour", "6 hours")

    def keep(batch, i):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")

    # In complete mode every batch holds all windows; the last one has the end's state.
    q = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{base}/out")
    last = last.where(F.col("batch") == last.agg(F.max("batch")).first()[0])
    return last.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("m4_backfill", ctes("papers") + f", h as (select paper_id, topic, publication_date as d from papers where publication_date is not null), s as (select c_custkey sid, 't' || (c_custkey % 7)::varchar topic, date '2021-04-01' + (c_custkey % 60)::int as cur from customer) select sid as subscription_id, paper_id from s join h using (topic) where d >= greatest(cur - 7, cur - 400, date '{AS_OF}' - 3000) and d < cur qualify row_number() over (partition by sid order by paper_id) <= 5")
def _(spark, sf):
    history = entity(spark, sf, "papers").where("publication_date is not null").select("paper_id", "topic", F.col("publication_date").alias("day"))
    c = F.col("c_custkey")
    cursor = F.date_add(F.lit("2021-04-01").cast("date"), (c % 60).cast("int"))
    subs = table(spark, sf, "customer").select(c.alias("subscription_id"), F.concat(F.lit("t"), (c % 7).cast("string")).alias("topic"), cursor.alias("cursor"), F.date_sub(cursor, 400).alias("created"))
    return M.backfill(history, subs, AS_OF, 3000, 5)


@query("m6_query_change", "select n_name as topic, n_nationkey % 3 = 0 and n_nationkey % 2 = 0 as changed from nation")
def _(spark, sf):
    n = table(spark, sf, "nation")
    state = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("topic"), F.sha2(F.when(F.col("n_nationkey") % 3 == 0, "old").otherwise(F.col("n_name")), 256).alias("query_hash"))
    return M.changed_queries(n.select(F.col("n_name").alias("topic"), F.col("n_name").alias("query")), state).select("topic", "changed")


@query("m9_synthesis_skip", ctes("papers") + " select topic, bool_and(pos % 100 <> 3) as unchanged from papers group by topic")
def _(spark, sf):
    papers = entity(spark, sf, "papers")
    now, then = registry_hash(papers, ["topic"], F.col("paper_id")), registry_hash(papers.where("pos % 100 != 3"), ["topic"], F.col("paper_id"))
    return now.join(then.withColumnRenamed("registry_hash", "old"), "topic").select("topic", (F.col("registry_hash") == F.col("old")).alias("unchanged"))


@query("m10_retention", ctes("papers") + f" select paper_id from papers where publication_date >= date '{AS_OF}' - 900")
def _(spark, sf):
    return M.retained(entity(spark, sf, "papers").withColumnRenamed("publication_date", "computed_at"), AS_OF, 900).select("paper_id")
