"""Queries of time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import timeseries as T
from inkwell.plans.registry import query
from inkwell.sources.entities import AS_OF, ctes, entity

P = ctes("points")


def _bucket_sql(unit: str) -> str:
    start = {"daily": "period", "weekly": "date_trunc('week', period)::date", "monthly": "date_trunc('month', period)::date"}[unit]
    end = {"daily": "s", "weekly": "s + 6", "monthly": "last_day(s)"}[unit]
    return P + f""", b as (select *, {start} as s from points) select series_id, metric_name, s::varchar as period_start, ({end})::date::varchar as period_end, count(*) as n, round(sum(value), 6) as sum_value,
      round(avg(value), 6) as avg_value, round(min(value), 6) as min_value, round(max(value), 6) as max_value from b group by series_id, metric_name, s"""


def _buckets(unit):
    def run(spark, sf):
        a = T.aggregate(entity(spark, sf, "points"), unit)
        return a.select("series_id", "metric_name", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "n", *(F.round(c, 6).alias(c) for c in ("sum_value", "avg_value", "min_value", "max_value")))

    return run


for _unit in ("daily", "weekly", "monthly"):
    query(f"a1_{_unit}_buckets", _bucket_sql(_unit))(_buckets(_unit))

_A2 = "(avg(value) filter (period >= date '{d}' - {w} and period <= date '{d}') - avg(value) filter (period >= date '{d}' - 2 * {w} and period < date '{d}' - {w})) / {w}"


@query("a2_velocity", P + f" select series_id, metric_name, round({_A2.format(d=AS_OF, w=7)}, 6) as velocity from points group by all")
def _(spark, sf):
    return T.velocity(entity(spark, sf, "points"), AS_OF, 7).withColumn("velocity", F.round("velocity", 6))


def _mean(i: int) -> str:
    return f"avg(value) filter (period >= date '{AS_OF}' - {7 * (i + 1)} and period < date '{AS_OF}' - {7 * i})"


@query("a3_acceleration", P + f" select series_id, metric_name, round((({_mean(0)} - {_mean(1)}) / 7 - ({_mean(1)} - {_mean(2)}) / 7) / 7, 6) as acceleration from points group by all")
def _(spark, sf):
    return T.acceleration(entity(spark, sf, "points"), AS_OF, 7).withColumn("acceleration", F.round("acceleration", 6))


@query(
    "a1_a2_weekly_velocity",
    P + f""", b as (select series_id, metric_name, date_trunc('week', period)::date s, count(*) n, avg(value) m from points group by all), v as (select series_id, metric_name, {_A2.format(d=AS_OF, w=7)} v from points group by all)
    select b.series_id, s::varchar as period_start, n, round(m, 6) as avg_value, round(v, 6) as velocity from b join v using (series_id, metric_name)""",
)
def _(spark, sf):
    points = entity(spark, sf, "points")
    return T.aggregate(points, "weekly").join(T.velocity(points, AS_OF, 7), [*T.KEY]).select("series_id", F.col("period_start").cast("string").alias("period_start"), "n", F.round("avg_value", 6).alias("avg_value"), F.round("velocity", 6).alias("velocity"))


@query("w6_rolling_mean", P + " select series_id, period::varchar as period, round(avg(value) over (partition by series_id, metric_name order by period range between interval 7 days preceding and current row), 6) as rolling from points")
def _(spark, sf):
    return T.rolling_mean(entity(spark, sf, "points"), 7).select("series_id", F.col("period").cast("string").alias("period"), F.round("rolling", 6).alias("rolling"))


@query("a6_series_names", P + " select distinct series_id, metric_name from points")
def _(spark, sf):
    return T.names(entity(spark, sf, "points"))


@query("o7_range_scan", P + " select period::varchar as period, round(value, 6) as value from points where series_id = 'purchase' and period between date '2024-01-05' and date '2024-01-20'")
def _(spark, sf):
    return T.between(entity(spark, sf, "points"), "purchase", "value", "2024-01-05", "2024-01-20").select(F.col("period").cast("string").alias("period"), F.round("value", 6).alias("value"))


@query("o8_latest_points", P + " select period::varchar as period, round(value, 6) as value from points where series_id = 'error' order by points.period desc limit 10")
def _(spark, sf):
    return T.latest(entity(spark, sf, "points"), "error", "value", 10).select(F.col("period").cast("string").alias("period"), F.round("value", 6).alias("value"))


@query("n16_point_lookup", P + " select series_id, round(value, 6) as value from points where series_id = 'error' and period = date '2024-01-15'")
def _(spark, sf):
    return entity(spark, sf, "points").where("series_id = 'error' and metric_name = 'value' and period = date '2024-01-15'").select("series_id", F.round("value", 6).alias("value"))


@query("k2_point_upsert", P + " select series_id, period::varchar as period, round(case when day(period) % 3 = 0 then 0 else value end, 6) as value from points")
def _(spark, sf):
    points = entity(spark, sf, "points").withColumn("ingest_seq", F.lit(1))
    new = points.where(F.dayofmonth("period") % 3 == 0).withColumn("value", F.lit(0.0)).withColumn("ingest_seq", F.lit(2))
    return T.upsert(points, new, ["series_id", "metric_name", "period"]).select("series_id", F.col("period").cast("string").alias("period"), F.round("value", 6).alias("value"))


@query("n15_delete_range", P + " select series_id, count(*) as n from points where not (series_id = 'error' and period between date '2024-01-05' and date '2024-01-10') group by series_id")
def _(spark, sf):
    return T.delete_range(entity(spark, sf, "points"), "error", None, "2024-01-05", "2024-01-10")[0].groupBy("series_id").agg(F.count("*").alias("n"))


@query("m12_event_windows", "select event_type, time_bucket(interval 6 hours, ts)::varchar as window_start, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, sf):
    from inkwell.sources.entities import table

    g = table(spark, sf, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "total")
