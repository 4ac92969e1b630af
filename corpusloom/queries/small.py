"""Smaller operators and maintenance queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import keys as K
from corpusloom.functions.references import BOOKS
from corpusloom.operators import fixpoint, matching
from corpusloom.operators.contract import SCREENS, screen_hits
from corpusloom.operators.relational import best_of, islands, spread
from corpusloom.queries.registry import query
from corpusloom.session import table
from corpusloom.sources.readers import occurrence_ids
from corpusloom.streaming import queue

# ---- joins


@query("""select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 30 days)""")
def semi_exists_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semi join by key and range: the range is a residual test of the equi-join."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    within = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"))
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & within, "left_semi").select("o_orderkey")


@query("""select c_custkey, n, total from customer left join lateral (select count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_custkey = c_custkey and o_orderstatus = 'F') a on c_acctbal > 0""")
def lateral_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate per row, where a condition on the row holds."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    both = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    good = F.col("c_acctbal") > 0
    return both.select("c_custkey", F.when(good, F.coalesce("n", F.lit(0))).alias("n"), F.when(good, F.round("total", 2)).alias("total"))


@query("""with p(batch, i, cust, status, price) as (select o_orderkey // 500, row_number() over (partition by o_orderkey // 500 order by o_orderkey), o_custkey, o_orderstatus, case when o_orderkey % 2 = 0 then o_totalprice end from orders)
select batch, i, o_orderkey from p join orders o on o.o_custkey = p.cust and o.o_orderstatus = p.status qualify row_number() over (partition by batch, i order by coalesce(o.o_totalprice = p.price, false) desc, o_orderkey) = 1""")
def locate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of probes as parallel arrays, numbered in order within each, with the row of each probe: the one whose content is equal, else the first."""
    o = table(spark, sf_dir, "orders")
    probe = F.struct("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"))
    # A batch is small by its definition, so its arrays are.
    batches = o.groupBy(F.floor(F.col("o_orderkey") / 500).alias("batch")).agg(F.array_sort(F.collect_list(probe)).alias("rows")).select("batch", *[F.col(f"rows.{c}").alias(c) for c in ("cust", "status", "price")])
    probes = batches.select("batch", F.posexplode(F.arrays_zip("cust", "status", "price")).alias("pos", "p")).select("batch", (F.col("pos") + 1).cast("long").alias("i"), "p.*")
    hit = probes.join(o, (F.col("o_custkey") == F.col("cust")) & (F.col("o_orderstatus") == F.col("status")))
    same = F.coalesce(F.col("o_totalprice") == F.col("price"), F.lit(False))
    return hit.groupBy("batch", "i").agg(F.min_by("o_orderkey", F.struct((~same).alias("other"), "o_orderkey")).alias("o_orderkey"))


# ---- aggregates


@query("select o_custkey, count(*) as documents, coalesce(sum(case when o_orderstatus <> 'P' then o_totalprice end), 0) + 1000 > 500000 as over_bytes, count(*) + 1 > 20 as over_documents from orders group by 1")
def upload_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one more upload of a size would go over an owner's limits; missing sizes count as nothing."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), F.lit(0.0)).alias("bytes"))
    return n.select("o_custkey", "documents", (F.col("bytes") + 1000 > 500000).alias("over_bytes"), (F.col("documents") + 1 > 20).alias("over_documents"))


@query("""select l_suppkey, count(*) as entries, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_partkey)) filter (where l_returnflag <> 'N') as tradition, arg_min(year(l_shipdate), (l_orderkey, l_linenumber, l_partkey)) as first_year, array_to_string(list_sort(list(distinct l_linenumber::varchar)), ',') as books from lineitem group by 1""")
def works_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's entries, the first tradition and year that are stated, and the books they cover."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    stated = F.min_by(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_returnflag") != "N", order))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("entries"), stated.alias("tradition"), F.min_by(F.year("l_shipdate"), order).alias("first_year"), F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("books")
    )


@query("""with w as (select distinct case when l_partkey % 2 = 0 then 'G' else 'H' end || l_partkey % 900 as strong, l_orderkey as verse_id from lineitem),
n as (select strong, count(*) as n from w group by 1) select strong, strong[1:1] || substring(strong, 2)::int // 100 as bucket, n, n > 400 as own_shard, min(verse_id) as first, max(verse_id) as last from w join n using (strong) group by strong, n""")
def concordance_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with how often they occur, the file they belong to, and whether they get a file of their own."""
    strong = F.concat(F.when(F.col("l_partkey") % 2 == 0, "G").otherwise("H"), (F.col("l_partkey") % 900).cast("string"))
    w = table(spark, sf_dir, "lineitem").select(strong.alias("strong"), F.col("l_orderkey").alias("verse_id")).distinct()
    bucket = F.concat(F.substring("strong", 1, 1), F.floor(F.substring("strong", 2, 9).cast("int") / 100).cast("string"))
    return w.groupBy("strong").agg(F.count("*").alias("n"), F.min("verse_id").alias("first"), F.max("verse_id").alias("last")).select("strong", bucket.alias("bucket"), "n", (F.col("n") > 400).alias("own_shard"), "first", "last")


@query("""with w as (select distinct case when l_partkey % 2 = 0 then 'G' else 'H' end || l_partkey % 900 as strong, l_orderkey as verse_id from lineitem) select verse_id from w where strong = 'G26'""")
def concordance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one number: the filter on its bucket and on itself reaches the table."""
    strong = F.concat(F.when(F.col("l_partkey") % 2 == 0, "G").otherwise("H"), (F.col("l_partkey") % 900).cast("string"))
    return table(spark, sf_dir, "lineitem").where(strong == "G26").select(F.col("l_orderkey").alias("verse_id")).distinct()


@query("select l_suppkey, l_returnflag, max(l_linenumber) as last from lineitem group by 1, 2")
def last_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_linenumber").alias("last"))


@query("select o_custkey, unit is null as alone, coalesce(unit, o_orderkey) as unit, count(*) as n, min(o_orderkey) as first from (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 5 end as unit from orders) group by 1, 2, 3")
def nulls_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a unit are groups of their own, and never fall together with a unit of the same number."""
    unit = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").groupBy("o_custkey", unit.isNull().alias("alone"), F.coalesce(unit, F.col("o_orderkey")).alias("unit")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


# ---- windows and order


@query("""with old as (select o_custkey, max(o_shippriority_) as m from (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as o_shippriority_ from orders where o_orderstatus = 'F') group by 1)
select n.o_custkey as o_custkey, o_orderkey, coalesce(m, 0) + row_number() over (partition by n.o_custkey order by o_orderkey) as slot from orders n left join old on old.o_custkey = n.o_custkey where o_orderstatus = 'O'""")
def appended_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows get the slots after the last one taken."""
    o = table(spark, sf_dir, "orders")
    taken = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("m"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.where("o_orderstatus = 'O'").join(taken, "o_custkey", "left").select("o_custkey", "o_orderkey", (F.coalesce("m", F.lit(0)) + nth).alias("slot"))


@query("""with k as (select l_suppkey, 'work:' || l_suppkey || ':' || (l_orderkey % 300) || case when l_linenumber > 3 then '.' || l_linenumber else '' end as key, l_orderkey, l_linenumber from lineitem)
select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by split_part(split_part(key, ':', 3), '.', 1)::bigint, coalesce(try_cast(nullif(split_part(split_part(key, ':', 3), '.', 2), '') as bigint), 0), l_orderkey, l_linenumber) as ordinal,
split_part(split_part(key, ':', 3), '.', 1)::bigint as section from k""")
def parsed_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered by the numbers in their keys, not by the keys as text."""
    tail = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("."), F.col("l_linenumber").cast("string"))).otherwise("")
    key = F.concat(F.lit("work:"), F.col("l_suppkey").cast("string"), F.lit(":"), (F.col("l_orderkey") % 300).cast("string"), tail)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", key.alias("key"))
    section, chunk = K.key_parts(F.col("key"))
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(section, chunk, "l_orderkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", nth.alias("ordinal"), section.alias("section"))


@query("""with e as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events)
select user_id from e where back <= 3 group by 1 having count(*) = 3 and count(distinct event_type) = 1""")
def trailing_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last three events are of one kind."""
    last = best_of(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).where("n = 3 and kinds = 1").select("user_id")


@query("""with p as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as total from orders where o_orderkey > 100)
select o_custkey, o_orderkey, case when n = least(total, 5) and total >= 5 then o_orderkey end as next_after from p where n <= 5""")
def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's next page of five after a key; the key to go on from, on its last row, only if the page is full."""
    first = best_of(table(spark, sf_dir, "orders").where("o_orderkey > 100").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")], 5)
    whole = Window.partitionBy("o_custkey")
    full = (F.count("*").over(whole) == 5) & (F.col("o_orderkey") == F.max("o_orderkey").over(whole))
    return first.select("o_custkey", "o_orderkey", F.when(full, F.col("o_orderkey")).alias("next_after"))


@query("select o_custkey, least(count(*), 8) as shown, count(*) > 8 as truncated from orders group by 1")
def truncation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row more than is shown tells whether there are more; no group is counted to its end."""
    nine = best_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")], 9)
    return nine.groupBy("o_custkey").agg(F.least(F.count("*"), F.lit(8)).alias("shown"), (F.count("*") > 8).alias("truncated"))


@query("select p_partkey from part where contains(p_name, 'bolt') order by (p_name = 'large bolt') desc, length(p_name), p_partkey limit 40")
def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.contains("p_name", F.lit("bolt"))).orderBy(F.desc(F.col("p_name") == "large bolt"), F.length("p_name"), "p_partkey").limit(40).select("p_partkey")


@query("select o_orderkey from orders where o_orderstatus = 'O' order by case when o_orderkey % 2 = 0 then o_orderdate end nulls first, o_orderkey limit 60")
def nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(claimed.asc_nulls_first(), "o_orderkey").limit(60).select("o_orderkey")


@query("select p_partkey, chr(65 + (p_partkey % 20)::int) || 'V' as between_letters, chr(66 + (p_partkey % 20)::int) as after from part")
def fractional_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places between a letter and the next, and after a letter."""
    letter = lambda n: F.char(65 + n + F.col("p_partkey") % 20)
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", K.place_between(letter(0), letter(1)).alias("between_letters"), K.place_between(letter(0), F.lit(None).cast("string")).alias("after"))


# ---- sets


@query("""select o_custkey as member, 'order' as reason from orders where o_totalprice > 400000 union select c_custkey, 'balance' from customer where c_acctbal > 9000 union select c_custkey, 'base' from customer where c_custkey < 10""")
def union_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several sources add to a table, each row once."""
    a = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("member"), F.lit("order").alias("reason"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "member")
    return a.unionByName(c.where("c_acctbal > 9000").select("member", F.lit("balance").alias("reason"))).unionByName(c.where("member < 10").select("member", F.lit("base").alias("reason"))).distinct()


@query("""with old as (select o_custkey as author, o_orderkey, case when o_orderkey % 4 = 0 then 'w' end as work from orders where o_orderstatus <> 'P'), new as (select o_custkey as author, o_orderkey, null::varchar as work from orders where o_orderstatus = 'P')
select * from new union all select * from old where work is not null or author not in (select author from new)""")
def merge_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries take the place of their authors' old ones; what belongs to a work stays."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), "o_orderkey", "o_orderstatus")
    old = o.where("o_orderstatus <> 'P'").select("author", "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "w").alias("work"))
    new = o.where("o_orderstatus = 'P'").select("author", "o_orderkey", F.lit(None).cast("string").alias("work"))
    stay = old.where("work is not null").unionByName(old.where("work is null").join(new.select("author").distinct(), "author", "left_anti").select("author", "o_orderkey", "work"))
    return new.unionByName(stay)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of suppliers whose goods were ordered together often enough."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = l.join(l.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("l_suppkey < other").groupBy("l_suppkey", "other").agg(F.count("*").alias("n"))
    return pairs.where("n >= 3 and other - l_suppkey <= 2").select(F.col("l_suppkey").alias("a"), F.col("other").alias("b"))


_EDGES = """l as (select distinct l_orderkey, l_suppkey from lineitem), e as (select x.l_suppkey as a, y.l_suppkey as b from l x join l y using (l_orderkey) where x.l_suppkey < y.l_suppkey and y.l_suppkey - x.l_suppkey <= 2 group by 1, 2 having count(*) >= 3)"""


@query(f"""with recursive {_EDGES}, u as (select a, b from e union select b, a from e), reach(node, other) as (select distinct a, a from u union select r.node, u.b from reach r join u on u.a = r.other) select node, min(other) as component from reach group by 1""")
def likeness_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of what is alike by more than a threshold: connected components."""
    return fixpoint.components(_edges(spark, sf_dir))


@query("""with recursive t as (select c_nationkey as a, s_nationkey as b, count(*) as n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey group by 1, 2),
k as (select a, b from t qualify row_number() over (partition by a order by n desc, b) = 1),
r(start, node) as (select a, a from k union select b, b from k union select r.start, k.b from r join k on k.a = r.node) select start, node from r""")
def tables_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reachable along references, to the fixed point: from each nation to the one that most of its customers' parts come from, and on."""
    parts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    trade = parts.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))
    links = best_of(trade, ["a"], [F.desc("n"), F.asc("b")]).select("a", "b")
    return fixpoint.reachable(links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))), links)


# ---- scalar functions


@query("""select c_custkey, trim(upper(c_mktsegment)) as upper, left(c_name, 5) as head, substring(c_name, 3, 4) as part, strpos(c_name, '#') as at, greatest(c_custkey, 7) as most, concat_ws('-', c_name, c_mktsegment) as joined, split_part(c_name, '#', 2) as second,
length(c_name) as n, starts_with(c_name, 'Customer') as starts, ltrim(' ' || c_name) as trimmed, c_custkey // 7 as quotient, c_custkey % 7 as remainder, round(c_acctbal, 1) as rounded, least(greatest(c_custkey, 10), 20) as clamped from customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.trim(F.upper("c_mktsegment")).alias("upper"), F.left(name, F.lit(5)).alias("head"), F.substring(name, 3, 4).alias("part"), F.instr(name, "#").cast("long").alias("at"),
        F.greatest("c_custkey", F.lit(7)).alias("most"), F.concat_ws("-", "c_name", "c_mktsegment").alias("joined"), F.split_part(name, F.lit("#"), F.lit(2)).alias("second"), F.length(name).cast("long").alias("n"),
        name.startswith("Customer").alias("starts"), F.ltrim(F.concat(F.lit(" "), name)).alias("trimmed"), F.floor(F.col("c_custkey") / 7).alias("quotient"), (F.col("c_custkey") % 7).alias("remainder"),
        F.round("c_acctbal", 1).alias("rounded"), F.least(F.greatest("c_custkey", F.lit(10)), F.lit(20)).alias("clamped"),
    )


@query(r"""select doc_id, regexp_replace(text, '[0-9]+', '#', 'g')[1:60] as masked, len(regexp_extract_all(text, '[A-Z][a-z]+')) as n_names, regexp_extract(text, '([a-z]+)ing', 1) as stem, regexp_matches(text, 'LICEN|licen') as cased, regexp_matches(lower(text), 'licen') as any_case from documents""")
def regex_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring(F.regexp_replace("text", "[0-9]+", "#"), 1, 60).alias("masked"), F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).cast("long").alias("n_names"),
        F.regexp_extract("text", "([a-z]+)ing", 1).alias("stem"), F.col("text").rlike("LICEN|licen").alias("cased"), F.col("text").rlike("(?i)licen").alias("any_case"),
    )


@query("""select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, strftime(ts::date + 10, '%Y-%m-%d') as later, ts > (select max(ts) from events) - interval 7 days as recent, epoch(date_trunc('second', ts))::bigint as seconds from events""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    both = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return both.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm:ss").alias("minute"), F.date_format(F.date_add(F.to_date("ts"), 10), "yyyy-MM-dd").alias("later"),
        (F.col("ts") > F.col("now") - F.expr("interval 7 days")).alias("recent"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("seconds"),
    )


@query("""with a as (select o_custkey, list(o_orderkey order by o_orderkey) as ks, list(o_orderstatus order by o_orderkey) as ss from orders group by 1)
select o_custkey, ks[1] as first, ks[-1] as last, len(ks) as n, list_contains(ss, 'P') as has_p from a""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    return a.select("o_custkey", F.element_at("rows.o_orderkey", 1).alias("first"), F.element_at("rows.o_orderkey", -1).alias("last"), F.size("rows").cast("long").alias("n"), F.array_contains("rows.o_orderstatus", "P").alias("has_p"))


_NAMES = "[" + ", ".join(f"'{b.name}'" for b in BOOKS) + "]"


@query(f"select o_orderkey, {_NAMES}[(o_custkey % 70 + 1)::int] as book from orders")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's name by its number, from a small map."""
    names = F.create_map(*[F.lit(x) for b in BOOKS for x in (b.number, b.name)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(names, (F.col("o_custkey") % 70 + 1).cast("int")).alias("book"))


@query("""select event_id, json_extract_string(props, '$.k')::int as k, event_type || ':' || json_extract_string(props, '$.k') as set_to, case when event_id % 2 = 0 then 'new' else json_extract_string(props, '$.k') end as merged from events""")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read, built, changed in one key and merged, the later object's keys winning."""
    old = F.from_json("props", "map<string, string>")
    built = F.to_json(F.struct(F.concat_ws(":", "event_type", old["k"]).alias("k")))
    later = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"))).otherwise(F.create_map().cast("map<string, string>"))
    keep = F.map_filter(old, lambda k, _: ~F.map_contains_key(later, k))
    return table(spark, sf_dir, "events").select("event_id", old["k"].cast("int").alias("k"), F.get_json_object(built, "$.k").alias("set_to"), F.map_concat(keep, later)["k"].alias("merged"))


@query("""select item_id, md5(text) as md5, sha256(text) as sha, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(regexp_replace(text, '[^ -~]', '', 'g'), ''), lambda c: ascii(c)::hugeint)), lambda h, c: (xor(h::bigint, c::bigint)::hugeint * 16777619) % 4294967296)::bigint as fnv from benchmark""")
def hash_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import fnv1a32

    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha"), fnv1a32(F.regexp_replace("text", "[^ -~]", "")).alias("fnv"))


@query("select o_orderkey, [14, 1999, 40, 444, null][(o_orderkey % 5 + 1)::int] as value from orders")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import roman

    written = F.element_at(F.array(*map(F.lit, ["xiv", "MCMXCIX", "XL", "cdxliv", "John"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", roman(written).alias("value"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'verb · 3rd person aorist active indicative singular' when 1 then 'noun · nominative singular feminine' when 2 then 'preposition + noun common feminine singular absolute' else 'verb qal perfect 3rd'[1:16] || ' masculine singular' end as said from orders""")
def word_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of tagged words in words."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, K.greek_code(F.lit("V- 3AAI-S--"))).when(k == 1, K.greek_code(F.lit("N- ----NSF-"))).when(k == 2, K.hebrew_code(F.lit("HR/Ncfsa"))).otherwise(K.hebrew_code(F.lit("HVqp3ms")))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))


@query("""with p as (select l_partkey, bit_or(1::bigint << (l_linenumber - 1)) as mask from lineitem group by 1) select l_partkey, mask, (mask & 4) <> 0 as has_third, bit_count(mask)::int as n from p""")
def bit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several editions hold something, as the bits of a mask."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bit_or(F.expr("shiftleft(1L, l_linenumber - 1)")).alias("mask"))
    editions = [str(i) for i in range(1, 8)]
    return p.select("l_partkey", "mask", K.mask_has(F.col("mask"), "3", editions).alias("has_third"), F.size(K.mask_names(F.col("mask"), editions)).alias("n"))


# ---- matching


@query("""with v as (select doc_id, lang, text from documents), j as (select lang, count(*) as n, count(*) filter (where text ilike '%license%') as m from v group by 1) select lang, n, m, round(100.0 * m / n, 4) as percent from j""")
def repair_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies by class with the share of what can be repaired."""
    classed = table(spark, sf_dir, "documents").select("lang", F.contains(F.lower("text"), F.lit("license")).alias("good"))
    return classed.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("good").alias("m")).withColumn("percent", F.round(100 * F.col("m") / F.col("n"), 4))


@query("""select o_orderkey, case when o_orderkey % 3 = 2 then 'you should' when o_orderkey % 3 = 1 then 'the bible clearly teaches' end as span, case when o_orderkey % 3 = 2 then 'screen:I3' else 'screen:I1' end as "check" from orders where o_orderkey % 3 <> 0""")
def screen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that an answer must not use, each once a rule whatever its case."""
    k = F.col("o_orderkey") % 3
    said = F.when(k == 2, "You should pray, and you Should go").when(k == 1, "Here the bible clearly teaches it").otherwise("He shoulders it")
    hits = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(screen_hits(said)))
    assert len(SCREENS) == 10
    return hits.select("o_orderkey", F.lower("span").alias("span"), "check")


@query("""with t as (select conv_id, turn, role, length(text) as n from conversations) select conv_id, count(*) filter (where role = 'assistant') >= 2 as voices_min, count(distinct role) >= 2 as traditions_min, bool_or(n > 400) as has_passages,
count(*) filter (where role = 'assistant') >= 2 and count(distinct role) >= 2 and bool_or(n > 400) as passed from t group by 1""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named expectations of each answer as columns, and whether all hold."""
    t = table(spark, sf_dir, "conversations")
    checks = {"voices_min": F.count_if(F.col("role") == "assistant") >= 2, "traditions_min": F.count_distinct("role") >= 2, "has_passages": F.bool_or(F.length("text") > 400)}
    found = t.groupBy("conv_id").agg(*[c.alias(n) for n, c in checks.items()])
    return found.withColumn("passed", F.col("voices_min") & F.col("traditions_min") & F.col("has_passages"))


# ---- pieces and plans


@query("""with h as (select label, vec_id % 2 as half, unnest(generate_series(0, len(embedding) - 1))::int as dim, unnest(embedding)::double as x from embeddings), m as (select label, half, dim, avg(x) as x from h group by 1, 2, 3),
p as (select label, dim, avg(x) as x from m group by 1, 2), n as (select label, sqrt(sum(x * x)) as size from p group by 1) select label, dim, round(x / size, 5) as x from p join n using (label)""")
def pooled_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text too long to be embedded at once: the mean of its halves' vectors, brought to length 1."""
    h = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.posexplode("embedding").alias("dim", "x"))
    halves = h.groupBy("label", "half", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = halves.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    size = pooled.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return pooled.join(F.broadcast(size), "label").select("label", "dim", F.round(F.col("x") / F.col("size"), 5).alias("x"))


_MARKS = "m as (select l_orderkey as t, l_partkey::bigint * 1000000 + l_suppkey * 10 + l_linenumber as o, least(l_partkey % 90, 100) as s, least(l_partkey % 90 + 1 + l_suppkey % 15, 100) as e, l_returnflag as color from lineitem)"


@query(f"""with {_MARKS}, b as (select t, s as x from m union select t, e from m union select distinct t, 0 from m union select distinct t, 100 from m), i as (select t, x as lo, lead(x) over (partition by t order by x) as hi from b),
w as (select i.t as t, lo, hi, arg_max(color, o) as color, max(o) as o from i left join m on m.t = i.t and s <= lo and hi <= e where hi is not null group by 1, 2, 3),
g as (select *, row_number() over (partition by t order by lo) - row_number() over (partition by t, color, o order by lo) as g from w) select t, min(lo) as start, max(hi) as "end", color from g group by t, g, color, o""")
def flattened_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping marks of a text as segments that cover it once, the last mark winning, equal neighbours merged."""
    start, end = F.col("l_partkey") % 90, F.least(F.col("l_partkey") % 90 + 1 + F.col("l_suppkey") % 15, F.lit(100))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), (F.col("l_partkey").cast("long") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("o"), start.alias("s"), end.alias("e"), F.col("l_returnflag").alias("color"))
    m = spread(m, "t", megabytes=0.5)  # every step below is of a text
    edges = m.select("t", F.explode(F.array("s", "e", F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("lo")).distinct()
    pieces = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy("t").orderBy("lo"))).where("hi is not null")
    covered = pieces.join(m, (pieces["t"] == m["t"]) & (m["s"] <= pieces["lo"]) & (pieces["hi"] <= m["e"]), "left").select(pieces["t"], "lo", "hi", "o", "color")
    won = covered.groupBy("t", "lo", "hi").agg(F.max_by("color", "o").alias("color"), F.max("o").alias("o"))
    runs = islands(won.withColumn("v", F.struct("color", "o")), ["t"], "lo", "v")
    return runs.groupBy("t", "v", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("end")).select("t", "start", "end", F.col("v.color").alias("color"))


@query("""with d as (select o_custkey, o_orderkey % 20 as day, max(o_totalprice) > 200000 as good from orders group by 1, 2) select o_custkey, count(*) as days, count(*) filter (where good) as covered, count(*) filter (where good) * 2 < count(*) as refused from d group by 1""")
def plan_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of which fewer than half of the days have enough to read are refused."""
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 20).alias("day")).agg((F.max("o_totalprice") > 200000).alias("good"))
    return days.groupBy("o_custkey").agg(F.count("*").alias("days"), F.count_if("good").alias("covered"), (F.count_if("good") * 2 < F.count("*")).alias("refused"))


@query("""with s as (select c_custkey, c_custkey % 120 as weeks, c_custkey % 9 as per_week, case when c_custkey % 5 <> 0 then '2024-02-' || lpad((c_custkey % 40)::varchar, 2, '0') else 'soon' end as start_date, case c_custkey % 3 when 0 then 'rom' when 1 then 'xxx' else 'jhn' end as book from customer)
select c_custkey, case when weeks < 1 or weeks > 104 then 'weeks' when per_week < 1 or per_week > 7 then 'days' when not regexp_full_match(start_date, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') then 'date' when book = 'xxx' then 'book' else 'ok' end as verdict from s""")
def plan_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans' settings checked field by field; the first that is wrong is named."""
    from corpusloom.plans.calendar import spec_fault

    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(
        "c_custkey", (k % 120).alias("weeks"), (k % 9).alias("per_week"), F.when(k % 5 != 0, F.concat(F.lit("2024-02-"), F.lpad((k % 40).cast("string"), 2, "0"))).otherwise("soon").alias("start_date"),
        F.when(k % 3 == 0, "rom").when(k % 3 == 1, "xxx").otherwise("jhn").alias("book"),
    )
    return s.select("c_custkey", F.coalesce(spec_fault(F.col("weeks"), F.col("per_week"), F.col("start_date"), F.col("book")), F.lit("ok")).alias("verdict"))


@query("select l_suppkey * 1000 + v as verse_id from (select l_suppkey, unnest(generate_series(1, max(l_linenumber))) as v from lineitem group by 1)")
def verse_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verse there is, from the number of verses of each chapter."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_linenumber").alias("n"))
    return n.select("l_suppkey", F.explode(F.sequence(F.lit(1), "n")).alias("v")).select((F.col("l_suppkey") * 1000 + F.col("v")).alias("verse_id"))


# ---- the queue

_QUEUE = """d as (select user_id, event_id as doc_id, ['queued', 'parsing', 'chunking', 'embedding', 'ready', 'failed'][(event_id % 6 + 1)::int] as status, case when event_id % 4 <> 0 then ts end as claimed_at, ts - interval 1 hour as created_at, (event_id % 5)::int as attempts from events),
n as (select date_trunc('second', max(ts)) as now from events)"""


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    now = e.agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("now"))
    status = F.element_at(F.array(*map(F.lit, ["queued", "parsing", "chunking", "embedding", "ready", "failed"])), (k % 6 + 1).cast("int"))
    d = e.select("user_id", k.alias("doc_id"), status.alias("status"), F.when(k % 4 != 0, F.col("ts")).alias("claimed_at"), (F.col("ts") - F.expr("interval 1 hour")).alias("created_at"), (k % 5).cast("int").alias("attempts"), F.lit(None).cast("string").alias("parse_error"))
    return d.join(F.broadcast(now)), F.col("now")


@query(f"""with {_QUEUE}, f as (select *, attempts < 3 and (status = 'queued' or (status in ('parsing', 'chunking', 'embedding') and claimed_at < now - interval 5 minutes)) as free from d, n)
select user_id, doc_id, attempts + 1 as attempts from f where coalesce(free, false) qualify row_number() over (partition by user_id order by claimed_at nulls first, created_at, doc_id) = 1""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's next document: never claimed ones, then the oldest, those of dead workers included, while attempts are left."""
    d, now = _documents(spark, sf_dir)
    return queue.claimed(d, now).where("taken").select("user_id", "doc_id", "attempts")


@query(f"""with {_QUEUE} select doc_id, 'Gave up after ' || attempts || ' attempts. The last error was: unknown' as reason from d, n where status in ('parsing', 'chunking', 'embedding') and claimed_at < now - interval 5 minutes and attempts >= 3""")
def exhausted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = _documents(spark, sf_dir)
    return queue.reaped(d.where(F.col("status") != "failed"), now).where("status = 'failed'").select("doc_id", F.col("parse_error").alias("reason"))


@query("""select event_id, case when event_id % 11 = 0 then 'failed' when event_id % 7 = 0 then 'empty' when event_id % 7 = 1 then 'failed' when event_type = 'error' then case when event_id % 3 = 0 or event_id % 4 >= 3 then 'failed' else 'queued' end when event_id % 13 = 0 then 'empty' else 'ready' end as status from events""")
def document_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each attempt at a document ends."""
    k = F.col("event_id")
    d = table(spark, sf_dir, "events").select(
        "event_id", (k % 11 != 0).alias("stored"), F.when(k % 7 == 0, "empty").when(k % 7 == 1, "needs_ocr").alias("refusal"), F.when(k % 13 == 0, 0).otherwise(5).alias("chunks"),
        F.when(F.col("event_type") == "error", "x").alias("error"), (k % 3 == 0).alias("permanent"), (k % 4).alias("attempts"),
    )
    return queue.outcome(d).select("event_id", "status")


@query(f"""with {_QUEUE}, w as (select user_id, count(*) as depth, min(created_at) as f from d where status in ('queued', 'parsing', 'chunking', 'embedding') group by 1), s as (select user_id, count(*) as sections from events group by 1)
select user_id, coalesce(depth, 0) as depth, epoch(now)::bigint - epoch(date_trunc('second', f))::bigint as oldest_seconds, sections, sections > 20000 as over from s left join w using (user_id), n""")
def queue_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _ = _documents(spark, sf_dir)
    at = table(spark, sf_dir, "events").agg(F.date_format(F.date_trunc("second", F.max("ts")), "yyyy-MM-dd HH:mm:ss")).first()[0]  # one value
    return queue.figures(d.drop("now"), table(spark, sf_dir, "events").select("user_id"), F.lit(at).cast("timestamp_ntz"))


@query("""with w as (select user_id as run_id, event_id as seq, case when event_type in ('error', 'click') then event_type end as code, event_type = 'view' as staged, event_id % 97 = 0 as limited, (event_id * 3)::int as elapsed from events),
t as (select run_id, code, row_number() over (partition by run_id order by seq desc) as back from w where code is not null), c as (select run_id, count(*) = 3 and count(distinct code) = 1 as same from t where back <= 3 group by 1),
n as (select run_id, count(*) as n, count(code) as bad, bool_or(limited) as limited, count(*) filter (where staged) as staged, max(elapsed) as elapsed from w group by 1),
k as (select run_id, case when coalesce(same, false) then 'consecutive-failure' when n >= 4 and bad / n > 0.3 then 'quarantine-rate' when limited or elapsed >= 21600 then 'budget' when staged >= 30 then 'staged-backlog' end as breaker from n left join c using (run_id))
select run_id, breaker, case when breaker in ('consecutive-failure', 'quarantine-rate') then 'halt' else 'pause' end as action from k where breaker is not null""")
def run_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that must stop or wait, and why."""
    kind = F.col("event_type")
    w = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(kind.isin("error", "click"), kind).alias("code"), (kind == "view").alias("staged"), (F.col("event_id") % 97 == 0).alias("rate_limited"), (F.col("event_id") * 3).cast("int").alias("elapsed")
    )
    return queue.breaker(w)


# ---- maintenance


@query(r"""select page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as source, case when regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) not in ('', '/') then regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) end as landing, 'ref.example.org' as referrer, not contains(url, 'ref=') or true as bounded from pages""")
def campaign_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an address says of how its reader came: listed parameters only, and another host's name."""
    a = K.attribution(F.col("url"), F.lit("https://ref.example.org/deep?private=1"))
    return table(spark, sf_dir, "pages").select("page_id", a.alias("a")).select("page_id", F.col("a")["utm_source"].alias("source"), F.col("a")["landing_path"].alias("landing"), F.col("a")["referrer_host"].alias("referrer"), (~F.map_contains_key("a", "ref")).alias("bounded"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 7 when 1 then 7 end as start, case o_orderkey % 3 when 0 then 18 when 1 then 18 end as "end" from orders""")
def paragraphs_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of a match, between blank lines or else line feeds; none where it is the whole text."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "First.\n\nSecond one.\n \nThird".replace("First.\n\n", "First\n\n")).when(k == 1, "First.\nSecond one.\nThird").otherwise("all in one second one")
    match = F.when(k == 2, "second one").otherwise(" Second  ")
    p = K.paragraph_around(text, match)
    return table(spark, sf_dir, "orders").select("o_orderkey", p["start"].alias("start"), p["end"].alias("end"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_orderkey + 1 when 1 then o_orderkey + 1 end as ordinal from orders""")
def source_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals in keys of three parts; keys of other forms have none."""
    k, n = F.col("o_orderkey") % 4, (F.col("o_orderkey") + 1).cast("string")
    key = F.when(k == 0, F.concat(F.lit("sermon:w:"), n)).when(k == 1, F.concat(F.lit("sermon:w:"), n, F.lit(".3"))).when(k == 2, F.concat(F.lit("commentary:jhn:3:"), n, F.lit("-16:x"))).otherwise("sermon:w:0")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.source_ordinal(key).alias("ordinal"))


@query("""with i as (select 'book' as kind, l_returnflag as key, count(*) as n from lineitem group by 2 union all select 'work', l_suppkey::varchar, count(*) from lineitem group by 2)
select sha256(string_agg(kind || chr(9) || key || chr(9) || n, chr(10) order by kind, key)) as inventory from i""")
def inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of what there is how often: a few counted rows, in order."""
    l = table(spark, sf_dir, "lineitem")
    count = lambda kind, c: l.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    every = count("book", "l_returnflag").unionByName(count("work", "l_suppkey"))
    lines = F.array_sort(F.collect_list(F.struct("kind", "key", "n")))
    return every.agg(F.sha2(F.array_join(F.transform(lines, lambda x: F.concat_ws("\t", x["kind"], x["key"], x["n"].cast("string"))), "\n"), 256).alias("inventory"))


_UNITS = """r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as island from orders),
k as (select *, min(o_orderkey) over (partition by o_custkey, o_orderstatus, island) as unit_key from r), u as (select o_custkey, o_orderkey, dense_rank() over (partition by o_custkey order by unit_key) as unit from k)"""


@query(f"with {_UNITS} select o_orderkey, unit as computed, unit + case when o_orderkey % 50 = 0 then 1 else 0 end as stored from u where o_orderkey % 50 = 0")
def recomputed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived column computed anew and compared with what is stored; the stored one is off where the key is divisible by 50."""
    runs = islands(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus")
    first = runs.withColumn("unit_key", F.min("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderstatus", "island")))
    units = first.select("o_orderkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("unit_key")).alias("computed"))
    stored = units.select("o_orderkey", (F.col("computed") + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("stored"))
    return units.join(stored, "o_orderkey").where(~F.col("computed").eqNullSafe(F.col("stored")))


@query("""with s as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as ordinal from orders)
select s.o_custkey as o_custkey, ordinal, l_linenumber, l_partkey from s join lineitem on l_orderkey = s.o_orderkey""")
def resliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows as sections with an ordinal that is computed once, and their anchors joined on it."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    sections = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", nth.alias("ordinal"))
    return sections.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "ordinal", "l_linenumber", "l_partkey")


@query(r"""with h as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages where url ilike '%example.com%' or url ilike '%EXAMPLE.net%') select page_id, host from h where host = 'example.com' or ends_with(host, '.example.com') or host = 'example.net' or ends_with(host, '.example.net')""")
def host_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that may be of some hosts by any part of them, then those that are by their host."""
    from corpusloom.functions import serving

    url = F.col("url")
    near = table(spark, sf_dir, "pages").where(serving.any_of(url.ilike(f"%{d}%") for d in ("example.com", "example.net")))
    return near.where(serving.forbidden_domain(url, ("example.com", "example.net")).isNotNull()).select("page_id", serving.host(url).alias("host"))


@query("""select count(*) filter (where o_orderkey % 10 = 0) as nulls, count(*) as total, o_orderstatus from orders group by 3""")
def null_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(unit.isNull()).alias("nulls"), F.count("*").alias("total"))


@query("select l_suppkey, l_partkey, l_linenumber, count(*) as n from lineitem group by 1, 2, 3 having count(*) > 1")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""with o as (select l_orderkey, l_linenumber, l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as before from lineitem) select l_orderkey, l_linenumber, before, l_partkey from o where before is not null and not l_partkey > before""")
def order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't come after the one before them."""
    o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("before"))
    return o.where("before is not null and not l_partkey > before")


@query("""with b as (select l_orderkey, l_linenumber, 'c:' || l_suppkey || ':' || l_returnflag as base from lineitem), n as (select *, row_number() over (partition by base order by l_orderkey, l_linenumber) - 1 as k from b) select l_orderkey, l_linenumber, case when k = 0 then base else base || '#' || k end as source_id from n""")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made from their parts, numbered from the second row of the same on."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.source_key(F.lit("c"), F.col("l_suppkey").cast("string"), F.col("l_returnflag")).alias("base"))
    return occurrence_ids(rows, "base", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "source_id")


@query(r"""with g as (select text, lang from documents where lang in ('en', 'fr', 'de')), v as (select lang, count(*) as n from g group by 1) select lang, n from v""")
def edition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr", "de")).groupBy("lang").agg(F.count("*").alias("n"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as g, p_brand as key from part), t as (select p_partkey, key, unnest(g) as token, g from w), q as (select token as english from (values ('bolts'), ('cold'), ('widget')) x(token)),
e as (select english, key, bool_or(token = english) as exact, min(p_partkey) as first from t, q where token = english or token || 's' = english group by 1, 2), b as (select english, bool_or(exact) as any_exact from e group by 1)
select e.english as english, key, first from e join b on b.english = e.english where exact or not any_exact""")
def word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original words that claim an English word's sense: exact tokens where there are any, else equal stems, one a key."""
    w = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"), F.col("p_name").alias("gloss"))
    asked = spark.createDataFrame([("bolts",), ("cold",), ("widget",)], "english string")
    return matching.word_senses(asked, w, "key", "gloss", "p_partkey").select("english", "key", F.col("first").alias("first"))
