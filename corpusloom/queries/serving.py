"""Which rows may be shown; customers stand for works, with authors and addresses made from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import serving as S
from corpusloom.queries.registry import query
from corpusloom.session import table

_AUTHORS = ["John Gill", "Origen of Alexandria", "CS Lewis  (in a letter)", "John Chrysostom", "Jerome's notes", "Pseudo-Jerome", "Augustine of Hippo", "Matthew Henry"]
_URLS = ["https://www.biblehub.com/x?y=1", "http://notbiblehub.com/y", "studylight.org/z", "https://ok.example:8080/a", "HTTPS://Historicalchristian.Faith"]


def _sql_list(names: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _in(names: list[str] | tuple[str, ...]) -> str:
    return "(" + _sql_list(names)[1:-1] + ")"


_WORKS = f"""works as (select c_custkey, c_nationkey as book, case when c_custkey % 11 <> 0 then {_sql_list(_AUTHORS)}[(c_custkey % 8 + 1)::int] end as author,
 case when c_custkey % 7 <> 0 then {_sql_list(_URLS)}[(c_custkey % 5 + 1)::int] end as url, case when c_custkey % 3 = 0 then 'w' || c_custkey % 4 end as work, c_mktsegment from customer)"""
_VETO = f"""coalesce(author in {_in(S.VETOED_AUTHORS)} or split_part(author, ' of ', 1) in {_in(S.VETOED_AUTHORS)} or split_part(author, ' the ', 1) in {_in(S.VETOED_AUTHORS)}
 or list_any_value(list_filter({_sql_list(S.VETOED_AUTHORS)}, lambda n: starts_with(author, n || ' '))) is not null or starts_with(author, 'Jerome''s'), false)"""
_CLEAN = f"(url is null or not (contains(lower(url), '{S.FORBIDDEN_DOMAINS[0]}') or contains(lower(url), '{S.FORBIDDEN_DOMAINS[1]}') or contains(lower(url), '{S.FORBIDDEN_DOMAINS[2]}')))"
_WHOLE = f"coalesce(author in {_in(S.PUBLISHED_AUTHORS)} or (author = 'John Chrysostom' and book in (40, 43, 44)) or (author = 'Augustine of Hippo' and book in (19, 43)), false)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("book"), F.when(key % 11 != 0, pick(_AUTHORS, 8)).alias("author"), F.when(key % 7 != 0, pick(_URLS, 5)).alias("url"),
        F.when(key % 3 == 0, F.concat(F.lit("w"), (key % 4).cast("string"))).alias("work"), "c_mktsegment",
    )


@query(f"with {_WORKS} select c_custkey, {_VETO} as vetoed, {_CLEAN} as clean from works")
def author_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("c_custkey", S.vetoed(F.col("author")).alias("vetoed"), S.clean_provenance(F.col("url")).alias("clean"))


_HOST = r"lower(nullif(regexp_extract(case when contains(url, '://') then url else 'https://' || url end, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1), ''))"


@query(f"""with {_WORKS}, h as (select c_custkey, {_HOST} as host from works)
select c_custkey, host, case when host = 'biblehub.com' or ends_with(host, '.biblehub.com') then 'biblehub.com' when host = 'studylight.org' or ends_with(host, '.studylight.org') then 'studylight.org'
when host = 'historicalchristian.faith' or ends_with(host, '.historicalchristian.faith') then 'historicalchristian.faith' end as forbidden from h""")
def forbidden_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("c_custkey", S.host(F.col("url")).alias("host"), S.forbidden_domain(F.col("url")).alias("forbidden"))


@query(f"with {_WORKS} select c_custkey, not {_VETO} and ({_WHOLE} or coalesce(work in ('w1', 'w2'), false)) as published, {_WHOLE} and {_CLEAN} and not {_VETO} as searchable from works")
def published_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    author, book = F.col("author"), F.col("book")
    return works(spark, sf_dir).select("c_custkey", S.published(author, book, F.col("work"), ["w1", "w2"]).alias("published"), S.searchable(author, book, F.col("url")).alias("searchable"))


@query("select o_orderkey, o_orderstatus from orders where o_orderpriority = '1-URGENT'")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two optional parameters one is given; the other leaves no trace in the plan."""
    return S.optional(table(spark, sf_dir, "orders"), o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey from (select o_orderkey, case when o_orderstatus = 'P' then o_orderdate end as deleted_at from orders) where deleted_at is null")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")))
    return S.live(marked).select("o_orderkey")


@query("select p_partkey, p_type from part where p_type = 'PROMO' or starts_with(p_type, 'PROMO ')")
def prefix_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(S.under_key(F.col("p_type"), "PROMO")).select("p_partkey", "p_type")


@query("""with t as (select c_custkey, ['commentary', 'father', 'sermon', 'hymn', 'poetry', 'theology', 'lexicon'][(c_custkey % 7 + 1)::int] as source_type from customer)
select c_custkey, source_type, source_type in ('commentary', 'father', 'sermon') as pooled, source_type = 'hymn' as hymns, true as unfenced, false as unknown from t""")
def catalog_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["commentary", "father", "sermon", "hymn", "poetry", "theology", "lexicon"]
    t = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % 7 + 1).cast("int")).alias("source_type"))
    kind = F.col("source_type")
    return t.select("c_custkey", "source_type", S.in_catalogs(kind, ["sermons", "commentaries"]).alias("pooled"), S.in_catalogs(kind, ["hymns-poetry"], "hymns").alias("hymns"), S.in_catalogs(kind).alias("unfenced"), S.in_catalogs(kind, ["nothing"]).alias("unknown"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as blocks that clip customers' sections and pool rows; sections, sources and the pool."""
    o, w = table(spark, sf_dir, "orders"), works(spark, sf_dir)
    n = F.col("o_orderkey")
    key = F.concat(F.when(F.col("o_custkey") % 2 == 0, "father:").otherwise("sermon:"), F.col("o_custkey").cast("string"))
    blocks = o.select(
        F.col("o_orderkey").alias("block_id"), F.when(n % 4 == 0, "text").otherwise("clipping").alias("kind"), F.when(n % 3 == 0, F.col("o_custkey")).alias("section_id"),
        F.when(n % 3 == 1, key).alias("source_key"), F.when(n % 5 != 0, "q").alias("quote"), F.lit("a").alias("attribution"),
    )
    sections = w.select(F.col("c_custkey").alias("section_id"), F.col("c_custkey").alias("source_id"), F.col("url").alias("source_url"))
    sources = w.select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_mktsegment") != "BUILDING", "published").otherwise("staged").alias("status"), "author")
    pool = w.select(F.lit("father").alias("source_type"), F.concat(F.lit("father:"), F.col("c_custkey").cast("string")).alias("source_key"), (F.col("c_custkey") % 6 != 0).alias("served"), F.lit(None).cast("string").alias("user_id"), F.col("url").alias("source_url"))
    return blocks, sections, sources, pool


@query(f"""with {_WORKS}, s as (select c_custkey from works where c_mktsegment <> 'BUILDING' and not {_VETO} and {_CLEAN}),
p as (select 'father:' || c_custkey as source_key from works where c_custkey % 6 <> 0 and {_CLEAN}),
b as (select o_orderkey as block_id, case when o_orderkey % 4 = 0 then 'text' else 'clipping' end as kind, case when o_orderkey % 3 = 0 then o_custkey end as section_id,
 case when o_orderkey % 3 = 1 then (case when o_custkey % 2 = 0 then 'father:' else 'sermon:' end) || o_custkey end as source_key, o_orderkey % 5 <> 0 as has_quote from orders)
select block_id, case when kind <> 'clipping' then 'text' when not has_quote then 'tombstone' when section_id in (select c_custkey from s) or source_key in (select source_key from p) then 'clipping' else 'tombstone' end as state from b""")
def servability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as they may be shown now: two positive look-ups, and a tombstone where neither succeeds."""
    blocks, sections, sources, pool = _blocks(spark, sf_dir)
    good = S.servable_sources(pool, blocks.where("source_key is not null").select("source_key"))
    return S.block_states(blocks, S.servable_sections(sections, sources), good).select("block_id", "state")


@query(f"""with {_WORKS} select source_key from (select distinct (case when o_custkey % 2 = 0 then 'father:' else 'sermon:' end) || o_custkey as source_key from orders where o_orderkey % 3 = 1) k
where (split_part(source_key, ':', 1), source_key) in (select 'father', 'father:' || c_custkey from works where c_custkey % 6 <> 0 and {_CLEAN})""")
def derived_key_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key and the type derived from it are both in the pool."""
    blocks, _, _, pool = _blocks(spark, sf_dir)
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 1").select(F.concat(F.when(F.col("o_custkey") % 2 == 0, "father:").otherwise("sermon:"), F.col("o_custkey").cast("string")).alias("source_key"))
    return S.servable_sources(pool, keys)


def scope(status: Column, kind: Column) -> Column:
    """What a history search may see."""
    return (status == "published") & (kind == "historian")


@query("select c_custkey from customer where c_mktsegment = 'MACHINERY' and c_nationkey >= 10")
def history_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, kind = F.when(F.col("c_nationkey") >= 10, "published").otherwise("staged"), F.when(F.col("c_mktsegment") == "MACHINERY", "historian").otherwise("sermon")
    return table(spark, sf_dir, "customer").where(scope(status, kind)).select("c_custkey")
