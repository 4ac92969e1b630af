"""Joins, aggregates, windows, pages, merges and reconciliations; orders stand for units, line items for anchors, customers for sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import digests
from corpusloom.operators.relational import best_of, capped_count, compared, insert_new, islands, keyset_page, page, replace_by_key, upsert
from corpusloom.queries.registry import query
from corpusloom.session import table


@query("select o_custkey, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def distinct_on_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_of(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""select l_returnflag, l_orderkey, l_linenumber from lineitem
qualify row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) <= 5""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return best_of(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 5).select("l_returnflag", "l_orderkey", "l_linenumber")


@query("""with f as (select user_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)
select event_type, count(*) as n_users from f group by 1""")
def first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min_by combines before the shuffle, which a window can't."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return first.groupBy("event_type").agg(F.count("*").alias("n_users"))


@query("""select o_custkey, count(distinct coalesce(nullif(l_linenumber, 7), -l_orderkey)) as n_units, min(l_orderkey) as first_order, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) as first_part, max(l_linenumber) as most_lines
from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def toc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents: units without a number of their own (7, here) are never merged."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    unit = F.coalesce(F.nullif(F.col("l_linenumber").cast("long"), F.lit(7).cast("long")), -F.col("l_orderkey"))
    return both.groupBy("o_custkey").agg(
        F.count_distinct(unit).alias("n_units"), F.min("l_orderkey").alias("first_order"),
        F.min_by("l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("first_part"), F.max("l_linenumber").alias("most_lines"),
    )


@query("""with r as (select o_custkey, o_orderstatus, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as island from orders)
select o_custkey, o_orderstatus, min(o_orderkey) as first_order, max(o_orderkey) as last_order, count(*) as n from r group by o_custkey, o_orderstatus, island""")
def gaps_islands_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = islands(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderstatus")
    return runs.groupBy("o_custkey", "o_orderstatus", "island").agg(F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"), F.count("*").alias("n")).drop("island")


@query("select l_orderkey, l_linenumber, dense_rank() over (partition by l_orderkey order by l_shipdate, l_partkey) as unit from lineitem")
def unit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.dense_rank().over(by).alias("unit"))


@query("select conv_id, turn, lag(turn) over w as previous_turn, lead(turn) over w as next_turn, lag(role) over w as previous_role from conversations window w as (partition by conv_id order by turn)")
def lead_lag_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(by).alias("previous_turn"), F.lead("turn").over(by).alias("next_turn"), F.lag("role").over(by).alias("previous_role"))


@query("""select c_custkey, o_orderkey as next_order from customer left join (select o_custkey, o_orderkey from orders where o_orderstatus = 'O'
  qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1) on o_custkey = c_custkey""")
def lateral_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open unit of each source, where there is one."""
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next_order"))
    return table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "next_order")


@query("select p_partkey, p_name from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 49)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return table(spark, sf_dir, "part").join(big, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select k as missing from generate_series(1, (select max(o_custkey) from orders)) t(k) where k not in (select o_custkey from orders)")
def missing_domain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("missing"))
    most = used.agg(F.max("missing")).first()[0] or 0  # one value; the range is dealt out by Spark
    return spark.range(1, most + 1).withColumnRenamed("id", "missing").join(used, "missing", "left_anti")


@query("""select s_suppkey, s_name, coalesce(n_name, 'unknown') as nation, coalesce(n, 0) as n_lines from supplier left join nation on n_nationkey = s_nationkey
left join (select l_suppkey, count(*) as n from lineitem group by 1) on l_suppkey = s_suppkey""")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated count as an aggregate before a left join."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return named.join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("""select l_suppkey, count(*) as n, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as rate from lineitem group by 1 having count(*) >= 200 and avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) >= 0.2""")
def collapse_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.avg((F.col("l_returnflag") == "R").cast("double"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), rate.alias("rate"))
    return found.where("n >= 200 and rate >= 0.2").withColumn("rate", F.round("rate", 6))


_SIDES = """a as (select l_partkey as k, count(*) as n from lineitem where l_linenumber <= 2 group by 1), b as (select l_partkey as k, count(*) as n from lineitem where l_linenumber in (2, 3) group by 1)"""
_CLASS = """case when a.k is null then 'missing_left' when b.k is null then 'missing_right' when a.n is not distinct from b.n then 'equal' else 'differs' end"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    count = lambda which: lines.where(which).groupBy("k").agg(F.count("*").alias("n"))
    return count("l_linenumber <= 2"), count("l_linenumber in (2, 3)")


@query(f"with {_SIDES} select coalesce(a.k, b.k) as k, a.n as left_value, b.n as right_value, {_CLASS} as class from a full join b on a.k = b.k where {_CLASS} <> 'equal'")
def parity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*_sides(spark, sf_dir), ["k"], "n").where("class <> 'equal'")


@query(f"with {_SIDES} select {_CLASS} as class, count(*) as n from a full join b on a.k = b.k group by 1")
def reconcile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*_sides(spark, sf_dir), ["k"], "n").groupBy("class").agg(F.count("*").alias("n"))


@query(f"with {_SIDES} select a.k as k, a.n as before, b.n as after from a left join b on a.k = b.k where b.n is null or b.n < a.n")
def count_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose count is gone or fell between two snapshots."""
    before, after = _sides(spark, sf_dir)
    return before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), "k", "left").where("after is null or after < before")


@query("select least(count(*), 1000)::bigint as total, count(*) >= 1000 as capped from lineitem where l_returnflag = 'R'")
def capped_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped_count(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"))


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey offset 40 limit 20")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), [F.asc("o_orderkey")], 20, 40)


@query("select o_orderkey, o_orderstatus from orders where o_orderkey > 100 order by o_orderkey limit 25")
def keyset_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], (100,), 25)


@query("select o_custkey, o_orderkey from orders where (o_custkey, o_orderkey) < (90, 500) order by o_custkey desc, o_orderkey desc limit 25")
def keyset_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], (90, 500), 25, descending=True)


@query("select c_mktsegment, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from customer group by 1")
def percent_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window runs over a few grouped rows."""
    n = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("select lang, quantile_disc(n_chars, 0.5) as median_chars, max(n_chars) as most_chars, bool_or(n_chars > 5000) as any_long from documents group by 1")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.expr("percentile_disc(0.5) within group (order by n_chars)").cast("long").alias("median_chars"), F.max("n_chars").alias("most_chars"), F.bool_or(F.col("n_chars") > 5000).alias("any_long"))


@query("select case when n_chars < 200 then '0' when n_chars < 1000 then '200' when n_chars < 5000 then '1000' else '5000' end as bucket, count(*) as n from documents group by 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    bucket = F.when(n < 200, "0").when(n < 1000, "200").when(n < 5000, "1000").otherwise("5000")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""with n as (select o_custkey, o_orderkey, o_orderstatus, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 1000 as part from orders),
p as (select o_custkey, part, md5(string_agg(o_orderkey::varchar || ':' || o_orderstatus, ',' order by o_orderkey)) as d from n group by 1, 2) select o_custkey, md5(string_agg(d, ',' order by part)) as digest from p group by 1""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a source, of the digests of a thousand rows each, so that no array holds a large source."""
    line = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    part = F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 1000)
    listed = lambda key, value: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(value).alias("v")))), lambda r: r["v"]), ",").cast("binary"))
    parts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line"), part.alias("part")).groupBy("o_custkey", "part").agg(listed("o_orderkey", "line").alias("d"))
    return parts.groupBy("o_custkey").agg(listed("part", "d").alias("digest"))


_LINE = "o_orderkey::varchar || ':' || o_custkey::varchar || ':' || o_orderstatus"
_LANE = lambda i: f"lpad(lower(to_hex((sum(('0x' || h[{1 + 16 * i}:{16 + 16 * i}])::ubigint::hugeint) % 18446744073709551616)::ubigint)), 16, '0')"


@query(f"""with r as (select o_orderpriority, sha256('1' || {_LINE}) as h from orders where o_orderkey % 10 <> 1)
select o_orderpriority, count(*) as n, {' || '.join(map(_LANE, range(4)))} as digest, true as same from r group by 1""")
def change_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored digest of the old rows, kept up to date by those inserted and deleted alone, and whether it is what all rows give."""
    o = table(spark, sf_dir, "orders")
    of = lambda rows: digests.of_rows(rows, F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus"), "o_orderpriority")
    last = F.col("o_orderkey") % 10
    updated = digests.changed(of(o.where(last != 0)), of(o.where(last == 0)), of(o.where(last == 1)), "o_orderpriority")
    again = of(o.where(last != 1)).select("o_orderpriority", digests.text(*map(F.col, digests.LANES)).alias("again"))
    return updated.join(again, "o_orderpriority", "full").select("o_orderpriority", "n", digests.text(*map(F.col, digests.LANES)).alias("digest"), (digests.text(*map(F.col, digests.LANES)) == F.col("again")).alias("same"))


@query("select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by 1")
def names_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))


@query("select l_suppkey, count(*) as n, count(*) filter (where l_linenumber = 1) as n_first, count(*) filter (where l_shipdate is null) as n_null from lineitem group by 1 having count(*) filter (where l_linenumber = 1) * 4 > count(*)")
def having_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("n_first"), F.count_if(F.col("l_shipdate").isNull()).alias("n_null"))
    return n.where("n_first * 4 > n")


_OLD, _NEW = "select o_orderkey, o_orderstatus, 1 as version from orders where o_orderstatus <> 'P'", "select o_orderkey, 'N' as o_orderstatus, 2 as version from orders where o_orderstatus <> 'F'"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    return old, orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.lit(2).alias("version"))


@query(f"with o as ({_OLD}), n as ({_NEW}) select * from n where o_orderkey not in (select o_orderkey from o)")
def merge_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_new(*_old_new(spark, sf_dir), ["o_orderkey"])


@query(f"select * from ({_OLD} union all {_NEW}) qualify row_number() over (partition by o_orderkey order by version desc) = 1")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(*_old_new(spark, sf_dir), ["o_orderkey"], "version")


@query(f"with o as ({_OLD}), n as ({_NEW}) select * from n union all select * from o where o_orderkey not in (select o_orderkey from n)")
def merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_by_key(*_old_new(spark, sf_dir), ["o_orderkey"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select o.o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) as o_orderstatus, n.o_orderstatus is distinct from o.o_orderstatus as changed from o left join n using (o_orderkey)")
def update_from_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    other = new.select("o_orderkey", F.col("o_orderstatus").alias("put"))
    return old.join(other, "o_orderkey", "left").select("o_orderkey", F.coalesce("put", "o_orderstatus").alias("o_orderstatus"), (~F.col("put").eqNullSafe(F.col("o_orderstatus"))).alias("changed"))


@query("select c_name from customer where (c_name ilike '%00%' or c_name = 'Customer#1') and c_mktsegment in ('BUILDING', 'AUTOMOBILE') and (c_nationkey is null or c_nationkey not in (1, 2))")
def predicate_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, nation = F.col("c_name"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").where((name.ilike("%00%") | (name == "Customer#1")) & F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE") & (nation.isNull() | ~nation.isin(1, 2))).select("c_name")
