"""Plans over units (orders of one source) and their calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import calendar
from corpusloom.queries.registry import query
from corpusloom.session import table


@query("""with p as (select o_custkey, min(o_orderdate)::date as start, count(*) as n from orders group by 1),
d as (select *, least(n, 24) as days, unnest(range(0, least(n, 24))) as d from p)
select o_custkey, d::int as day, floor(d * n / days)::int as first, (floor((d + 1) * n / days) - 1)::int as last, strftime(start + ((d // 3) * 7 + [0, 2, 4][(d % 3 + 1)::int])::int, '%Y-%m-%d') as date from d""")
def plan_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a plan that begins with the first of them: three days a week, 24 days at most."""
    plans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.count("*").alias("n"))
    return calendar.expanded(plans, "o_custkey", "start", "n", 24, [0, 2, 4]).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""with u as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, greatest(count(*) over (partition by o_custkey), 2) as n from orders)
select o_custkey, o_orderkey, (i * 2) // n as day from u""")
def plan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each source in order, over two days."""
    from pyspark.sql import Window

    u = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    by = Window.partitionBy("o_custkey")
    n = F.greatest(F.count("*").over(by), F.lit(2))
    return u.withColumn("day", F.floor((F.row_number().over(by.orderBy("o_orderkey")) - 1) * 2 / n).cast("long"))


@query("select o_orderkey, strftime(o_orderdate::date + 14, '%Y-%m-%d') as date, o_orderdate::date + 14 > date '1998-01-01' as late from orders where o_orderstatus = 'O'")
def plan_reschedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.date_add(F.to_date("o_orderdate"), 14)
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.date_format(moved, "yyyy-MM-dd").alias("date"), (moved > F.lit("1998-01-01").cast("date")).alias("late"))


@query("select o_custkey, count(*) as n_units, count(*) filter (where o_orderstatus = 'F') as n_done, min(case when o_orderstatus <> 'F' then o_orderkey end) as next_unit from orders group by 1")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_units"), F.count_if(done).alias("n_done"), F.min(F.when(~done, F.col("o_orderkey"))).alias("next_unit"))
