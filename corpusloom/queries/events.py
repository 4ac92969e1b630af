"""Activity counts, attribution, counters by window, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.relational import islands
from corpusloom.queries.registry import query
from corpusloom.session import table
from corpusloom.streaming import counters

_DAY = "strftime(ts, '%Y-%m-%d')"


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


@query("""with m as (select max(ts)::date as today from events)
select count(distinct user_id) filter (where ts::date = today) as dau, count(distinct user_id) filter (where ts::date > today - 7) as wau, count(distinct user_id) filter (where ts::date > today - 30) as mau from events, m""")
def dau_wau_mau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative to the last event's day, which is one row and so is broadcast."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    both = e.join(F.broadcast(e.agg(F.max("day").alias("today"))))
    since = lambda days: F.count_distinct(F.when(F.col("day") > F.date_sub("today", days), F.col("user_id")))
    return both.agg(since(1).alias("dau"), since(7).alias("wau"), since(30).alias("mau"))


@query("""with m as (select max(ts)::date as today from events), l as (select user_id, max(ts)::date as last from events group by 1)
select last <= today - 3 as churned, count(*) as n_users from l, m group by 1""")
def churn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last"))
    both = last.join(F.broadcast(last.agg(F.max("last").alias("today"))))
    return both.groupBy((F.col("last") <= F.date_sub("today", 3)).alias("churned")).agg(F.count("*").alias("n_users"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean_value, round(avg((value < 1)::int), 6) as low_share from events group by 1")
def surface_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg((F.col("value") < 1).cast("double")), 6).alias("low_share"))


@query("select json_extract_string(props, '$.k')::int as k, count(*) as n from events where value < 2 group by 1 order by n desc, k limit 20")
def zero_result_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "events").where("value < 2").select(F.get_json_object("props", "$.k").cast("int").alias("k"))
    return low.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(20)


@query("select event_id, json_extract_string(props, '$.k')::int as k from events where json_extract_string(props, '$.k')::int between 10 and 20")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where(F.col("k").between(10, 20))


@query("""with log as (select 'event' as kind, event_type as name, event_id as id from events union all
select 'turn' as kind, role as name, conv_id * 1000 + turn as id from conversations)
select kind, name, id from log where name in ('click', 'error', 'user') order by id desc, kind limit 100""")
def query_log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs in one shape; the latest of some names, whichever log they are in."""
    a = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_type").alias("name"), F.col("event_id").alias("id"))
    b = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("role").alias("name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return a.unionByName(b).where(F.col("name").isin("click", "error", "user")).orderBy(F.desc("id"), "kind").limit(100)


@query("select strftime(time_bucket(interval 10 minutes, ts), '%Y-%m-%d %H:%M') as start, user_id, count(*) as n from events group by 1, 2")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = counters.windowed(table(spark, sf_dir, "events"), "10 minutes")
    return n.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


@query(f"""with m as (select *, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) as in_minute from events),
d as (select *, case when in_minute <= 2 then row_number() over (partition by user_id, {_DAY}, in_minute <= 2 order by ts, event_id) end as in_day from m),
v as (select event_id, ts, case when in_minute > 2 then 'minute' when in_day > 10 then 'day' else 'ok' end as verdict from d)
select event_id, case when verdict = 'ok' and row_number() over (partition by ts::date, verdict order by ts, event_id) > 25 then 'global' else verdict end as verdict from v""")
def rate_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request that its minute refuses doesn't count for its day, nor one that its day refuses for all users' day."""
    return counters.capped(table(spark, sf_dir, "events"), per_minute=2, per_day=10, in_all=25).select("event_id", "verdict")


@query(f"select distinct user_id, {_DAY} as day from events")
def daily_active_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", _day(F.col("ts")).alias("day")).distinct()


@query("""with d as (select distinct user_id, ts::date as day from events), r as (select user_id, day, day - row_number() over (partition by user_id order by day)::int as island from d),
s as (select user_id, count(*) as n, min(day) as first from r group by user_id, island) select user_id, max(n) as longest from s group by 1""")
def activity_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", run).groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("""with r as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as island from events),
s as (select user_id, event_type, island, count(*) as n from r group by 1, 2, 3) select user_id, event_type, max(n) as longest from s group by 1, 2 having max(n) >= 3""")
def repeat_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with one kind of event three or more times in a row."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    runs = islands(e, ["user_id"], "at", "event_type").groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id", "event_type").agg(F.max("n").alias("longest")).where("longest >= 3")


@query("""select user_id, event_id from events where event_type in ('error', 'click') qualify row_number() over (partition by user_id order by (event_type = 'error') desc, ts, event_id) = 1""")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next job of each user: failed ones first, then the oldest."""
    jobs = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click"))
    next_ = F.min_by("event_id", F.struct((F.col("event_type") != "error").alias("later"), "ts", "event_id"))
    return jobs.groupBy("user_id").agg(next_.alias("event_id"))


@query("select event_type, count(*) as depth, date_diff('second', min(ts), (select max(ts) from events)) as oldest_age from events group by 1")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per_type = e.groupBy("event_type").agg(F.count("*").alias("depth"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = per_type.join(F.broadcast(per_type.agg(F.max("last").alias("now"))))
    second = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return both.select("event_type", "depth", (second(F.col("now")) - second(F.col("first"))).alias("oldest_age"))
