"""Point and interval joins, coverage censuses; orders are intervals of part keys, line items points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import ranges, sweep
from corpusloom.queries.registry import query
from corpusloom.session import table

_SPANS = "spans as (select o_orderkey, o_custkey, o_orderstatus, o_custkey as lo, o_custkey + o_orderkey % 40 as hi from orders)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an interval."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("hi"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand")


@query(f"with {_SPANS} select p_partkey, o_orderkey from part join spans on p_partkey between lo and hi")
def range_join_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.stab(_points(spark, sf_dir), _spans(spark, sf_dir), "p_partkey", "lo", "hi", 64).select("p_partkey", "o_orderkey")


@query(f"with {_SPANS}, b as (select n_nationkey, n_nationkey * 60 as lo, n_nationkey * 60 + 59 as hi from nation) select o_orderkey, n_nationkey from spans join b on spans.lo <= b.hi and b.lo <= spans.hi")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of two kinds that share a point; intervals of one kind with each other would be all pairs of a crowded place."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey").cast("long") * 60).alias("b1"), (F.col("n_nationkey").cast("long") * 60 + 59).alias("b2"))
    return ranges.overlaps(_spans(spark, sf_dir), n, ("lo", "hi"), ("b1", "b2"), 64).select("o_orderkey", "n_nationkey")


@query(f"with {_SPANS} select p_partkey, count(distinct o_custkey) as n_sources, count(distinct o_orderkey) as n_units from part join spans on p_partkey between lo and hi group by 1")
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    n = sweep.covered(_points(spark, sf_dir).select("p_partkey"), spans, "p_partkey", "lo", "hi", "o_custkey", "n_sources")
    return sweep.covered(n.where("n_sources > 0"), spans, "p_partkey", "lo", "hi", "o_orderkey", "n_units")


@query(f"""with {_SPANS}, c as (select p_partkey, count(distinct o_custkey) as n from part left join spans on p_partkey between lo and hi group by 1)
select least(n, 3) as n_sources, count(*) as n_points from c group by 1""")
def voice_floor_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sweep.covered(_points(spark, sf_dir), _spans(spark, sf_dir), "p_partkey", "lo", "hi", "o_custkey")
    return n.select(F.least("n", F.lit(3)).alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n_points"))


@query(f"""with {_SPANS}, c as (select p_brand, p_partkey, count(o_orderkey) > 0 as hit from part left join spans on p_partkey between lo and hi group by 1, 2)
select p_brand, count(*) as n_points, count(*) filter (where hit) as n_covered, round(count(*) filter (where hit) / count(*), 6) as share from c group by 1""")
def coverage_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sweep.covered(_points(spark, sf_dir), _spans(spark, sf_dir), "p_partkey", "lo", "hi")
    return every.groupBy("p_brand").agg(F.count("*").alias("n_points"), F.count_if(F.col("n") > 0).alias("n_covered")).withColumn("share", F.round(F.col("n_covered") / F.col("n_points"), 6))


@query(f"""with {_SPANS}, x as (select p_partkey, count(distinct o_custkey) as n from part join spans on p_partkey between lo and hi group by 1),
y as (select p_partkey, count(distinct o_custkey) as n from part join spans on p_partkey between lo and hi where o_orderstatus <> 'F' group by 1)
select x.p_partkey as p_partkey, x.n as before, coalesce(y.n, 0) as after, case when coalesce(y.n, 0) < 2 and x.n >= 2 then 'floor_broken' else 'fewer' end as class from x left join y on x.p_partkey = y.p_partkey where coalesce(y.n, 0) < x.n""")
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that lose sources when some are withdrawn, and those that fall under two."""
    spans = _spans(spark, sf_dir)
    before = sweep.covered(_points(spark, sf_dir).select("p_partkey"), spans, "p_partkey", "lo", "hi", "o_custkey", "before")
    both = sweep.covered(before.where("before > 0"), spans.where("o_orderstatus <> 'F'"), "p_partkey", "lo", "hi", "o_custkey", "after")
    return both.where("after < before").withColumn("class", F.when((F.col("after") < 2) & (F.col("before") >= 2), "floor_broken").otherwise("fewer"))


@query(f"with {_SPANS} select p_partkey from part where not exists (select 1 from spans where p_partkey between lo and hi)")
def grounding_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.uncovered(_points(spark, sf_dir), _spans(spark, sf_dir), "p_partkey", "lo", "hi").select("p_partkey")


@query(f"with {_SPANS} select p_brand, min(o_orderkey) as first_unit from part join spans on p_partkey between lo and hi group by 1")
def first_match_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranges.stab(_points(spark, sf_dir), _spans(spark, sf_dir), "p_partkey", "lo", "hi", 64)
    return hits.groupBy("p_brand").agg(F.min("o_orderkey").alias("first_unit"))


@query(f"""with {_SPANS}, h as (select p_brand, count(distinct o_orderkey) as n_ranges, count(*) as n_hits from part join spans on p_partkey between lo and hi where o_orderstatus = 'O' group by 1)
select p_brand, n_ranges, n_hits from h order by n_ranges desc, p_brand limit 10""")
def tradition_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups ranked by how many different ranges they touch."""
    hits = ranges.stab(_points(spark, sf_dir), _spans(spark, sf_dir).where("o_orderstatus = 'O'"), "p_partkey", "lo", "hi", 64)
    n = hits.groupBy("p_brand").agg(F.count_distinct("o_orderkey").alias("n_ranges"), F.count("*").alias("n_hits"))
    return n.orderBy(F.desc("n_ranges"), "p_brand").limit(10)


@query("""select o_orderkey, o_custkey % 60 * 1000000 + o_orderkey % 150 * 1000 + 1 as k, (o_custkey % 60 * 1000000 + o_orderkey % 150 * 1000 + 1) // 1000000 as book, o_orderkey % 150 as chapter, 1 as verse,
case when o_orderkey % 2 = 0 then o_custkey % 60 * 1000000 + o_orderkey % 150 * 1000 + 5 else o_custkey % 60 * 1000000 + o_orderkey % 150 * 1000 + 999 end as last from orders""")
def range_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made, taken apart, and ranges clamped to their chapter."""
    o = table(spark, sf_dir, "orders").withColumn("k", ranges.key(F.col("o_custkey") % 60, F.col("o_orderkey") % 150, F.lit(1)))
    book, chapter, verse = ranges.parts(F.col("k"))
    end = F.col("k") + F.when(F.col("o_orderkey") % 2 == 0, 4).otherwise(5000)
    return o.select("o_orderkey", "k", book.alias("book"), chapter.alias("chapter"), verse.alias("verse"), ranges.clamped(F.col("k"), end).alias("last"))
