"""Checks before texts are let in; tables stand for manifests, editions and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import gates as G
from corpusloom.queries.registry import query
from corpusloom.queries.serving import _AUTHORS, _HOST, _URLS, _VETO, _sql_list
from corpusloom.session import table

_DOMAIN = """case when host = 'biblehub.com' or ends_with(host, '.biblehub.com') then 'biblehub.com' when host = 'studylight.org' or ends_with(host, '.studylight.org') then 'studylight.org'
when host = 'historicalchristian.faith' or ends_with(host, '.historicalchristian.faith') then 'historicalchristian.faith' end"""
_MANIFEST = f"""m0 as (select c_custkey as position, case when c_custkey % 10 <> 0 then 'w' || c_custkey // 2 end as id, c_name as title, case when c_custkey % 9 <> 0 then c_mktsegment else ' ' end as author,
['Public Domain', 'CC BY', 'CC BY-NC', null][(c_custkey % 4 + 1)::int] as license, {_sql_list(_URLS)}[(c_custkey % 5 + 1)::int] as url, case when c_custkey % 6 <> 0 then 'first' end as edition, case when c_custkey % 8 <> 0 then c_nationkey end as year,
case when c_custkey % 12 = 0 then 'held' end as quarantine from customer), m as (select *, {_HOST} as host, row_number() over (partition by id order by position) as n from m0)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("position"), F.when(k % 10 != 0, F.concat(F.lit("w"), F.floor(k / 2).cast("string"))).alias("id"), F.col("c_name").alias("title"), F.when(k % 9 != 0, F.col("c_mktsegment")).otherwise(" ").alias("author"),
        pick(["Public Domain", "CC BY", "CC BY-NC", None], 4).alias("license"), pick(_URLS, 5).alias("url"), F.when(k % 6 != 0, "first").alias("edition"), F.when(k % 8 != 0, F.col("c_nationkey")).alias("year"), F.when(k % 12 == 0, "held").alias("quarantine"),
    )


@query(f"""with {_MANIFEST}, named as (select *, coalesce(id, '[' || position || ']') as shown from m)
select position, shown as id, 'id is missing' as reason from named where id is null union all select position, shown, 'duplicate id' from named where id is not null and n > 1
union all select position, shown, 'author is missing' from named where trim(author) = '' union all select position, shown, 'license is missing' from named where license is null
union all select position, shown, 'license is not allowed' from named where license = 'CC BY-NC' union all select position, shown, 'edition is missing' from named where edition is null
union all select position, shown, 'year is missing' from named where year is null
union all select position, shown, 'forbidden source ' || d from (select *, {_DOMAIN} as d from named) where d is not null and quarantine is null""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.manifest_violations(_manifest(spark, sf_dir))


_COUNTS = """c as (select o_orderstatus as edition, 'b' || o_custkey % 40 as book, (o_orderkey % 30 + 1)::int as chapter, count(*) as verses, count(*) filter (where o_custkey % 40 = 7) as empty from orders group by 1, 2, 3),
canon as (select 'b' || o_custkey % 40 as book, (o_orderkey % 30 + 1)::int as chapter, count(*) as verses from orders where o_orderstatus = 'F' group by 1, 2),
r as (select edition, book from c group by 1, 2 having not sum(empty) > 0.9 * sum(verses)),
w as (select edition, book, chapter, verses as want from r join canon using (book)), g as (select edition, book, chapter, verses as got from c where (edition, book) in (select (edition, book) from r)),
d as (select coalesce(w.edition, g.edition) as edition, coalesce(w.book, g.book) as book, coalesce(w.chapter, g.chapter) as chapter, got, want from w full join g on w.edition = g.edition and w.book = g.book and w.chapter = g.chapter where got is distinct from want),
e as (select *, case when abs(got - want) <= 1 then 'variant' else 'error' end as class from d)"""


def _differences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumn("book", F.concat(F.lit("b"), (F.col("o_custkey") % 40).cast("string"))).withColumn("chapter", (F.col("o_orderkey") % 30 + 1).cast("int"))
    counts = o.groupBy(F.col("o_orderstatus").alias("edition"), "book", "chapter").agg(F.count("*").alias("verses"), F.count_if(F.col("o_custkey") % 40 == 7).alias("empty"))
    canon = o.where("o_orderstatus = 'F'").groupBy("book", "chapter").agg(F.count("*").alias("verses"))
    return G.versification(counts, canon), counts


@query(f"with {_COUNTS} select edition, book, chapter, got, want, class from e")
def versification_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir)[0]


@query(f"with {_COUNTS} select edition, count(*) filter (where class = 'variant') as variants, count(*) filter (where class = 'error') as errors, count(*) filter (where class = 'error') = 0 and count(*) filter (where class = 'variant') <= 25 as ok from (select distinct edition from c) left join e using (edition) group by 1")
def versification_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    differences, counts = _differences(spark, sf_dir)
    return G.versification_verdicts(differences, counts)


_ENTRY = "select l_orderkey * 10 + l_linenumber as id, case l_partkey % 5 when 0 then ' ' when 1 then 'It&#8217;s so' when 2 then 'a <b>bold</b> word' when 3 then 'plain &copy; text' else 'plain' end as text, (l_suppkey % 4)::int as verse_start, (l_partkey % 6)::int as verse_end, (l_linenumber % 3)::int as chapter from lineitem"


def _sane_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    text = F.when(k == 0, " ").when(k == 1, "It&#8217;s so").when(k == 2, "a <b>bold</b> word").when(k == 3, "plain &copy; text").otherwise("plain")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"), (F.col("l_suppkey") % 4).cast("int").alias("verse_start"), (F.col("l_partkey") % 6).cast("int").alias("verse_end"), (F.col("l_linenumber") % 3).cast("int").alias("chapter"))


_SANITY = f"""e as ({_ENTRY}), sv as (select id, case when trim(text) = '' then 'empty text' when contains(text, '&#8217;') then 'quote-breaking entity' when contains(text, '<b>') then 'residual tag' end as reason from e
union all select id, 'insane keys' from e where not (verse_start >= 1 and verse_end >= verse_start and verse_end <= 200 and chapter >= 1)), s as (select id, reason from sv where reason is not null)"""


@query(f"with {_SANITY} select id, reason from s")
def content_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sanity(_sane_entries(spark, sf_dir))


@query()
def content_sanity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a sample of 500 entries, a sampling gate; Spark's hash orders it."""
    return G.sanity(_sane_entries(spark, sf_dir), 500)


_SERVED = f"v as (select l_suppkey, {_sql_list(_AUTHORS)}[(l_suppkey % 8 + 1)::int] as author, {_sql_list(_URLS)}[(l_partkey % 5 + 1)::int] as url, l_returnflag = 'R' as served from lineitem), h as (select *, {_HOST} as host from v)"


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, c, n: F.element_at(F.array(*map(F.lit, xs)), (c % n + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(pick(_AUTHORS, F.col("l_suppkey"), 8).alias("author"), pick(_URLS, F.col("l_partkey"), 5).alias("url"), (F.col("l_returnflag") == "R").alias("served"))


_BROKEN = f"b as (select author, 'served-provenance' as rule, count(*) as n from h where served and {_DOMAIN} is not null group by 1 union all select author, 'must-not-serve', count(*) from h where served and {_VETO} group by 1)"


@query(f"with {_SERVED}, {_BROKEN} select * from b")
def served_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.served_violations(_served(spark, sf_dir))


@query(f"""with {_SERVED}, {_BROKEN}, {_SANITY}, {_MANIFEST}, k as (select l_suppkey as author, count(*) as n from lineitem group by 1 having count(*) >= 200 and avg((l_linenumber = l_suppkey % 7)::int) >= 0.2)
select 'L1 manifest' as gate, 'irreversible' as tier, (select count(*) from m where id is null) + (select count(*) from m where id is not null and n > 1) + (select count(*) from m where trim(author) = '') + (select count(*) from m where license is null or license = 'CC BY-NC')
 + (select count(*) from m where edition is null) + (select count(*) from m where year is null) + (select count(*) from m where {_DOMAIN} is not null and quarantine is null) as found, false as ok
union all select 'L3 served', 'irreversible', (select count(*) from b), (select count(*) from b) = 0 union all select 'R2 keys', 'reversible', (select count(*) from k), (select count(*) from k) = 0
union all select 'R4 sanity', 'reversible', (select count(*) from s), (select count(*) from s) = 0""")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks with what they found."""
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_linenumber").alias("verse_start"), F.col("l_linenumber").alias("verse_end"), (F.col("l_suppkey") % 7).alias("chapter"))
    return G.gate([
        ("L1 manifest", "irreversible", G.manifest_violations(_manifest(spark, sf_dir))), ("L3 served", "irreversible", G.served_violations(_served(spark, sf_dir))),
        ("R2 keys", "reversible", G.collapsed_keys(keyed)), ("R4 sanity", "reversible", G.sanity(_sane_entries(spark, sf_dir))),
    ])


@query("""select event_id, case event_type when 'click' then 'embed-429' when 'view' then 'fetch' when 'purchase' then 'license' when 'error' then 'parse' else 'unknown' end as class from events""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    message = F.when(kind == "click", "HTTP 500: Rate limit, parse later").when(kind == "view", "socket hang up after provenance").when(kind == "purchase", "No licence given, structure unknown").when(kind == "error", "Malformed text").otherwise("what is this")
    return table(spark, sf_dir, "events").select("event_id", G.failure_class(message).alias("class"))


_RECONCILE = """w as (select l_partkey as work, count(*) as rows, count(*) filter (where l_returnflag <> 'N') as served, count(*) filter (where l_returnflag = 'N' and l_linenumber = 1) as clean, count(*) filter (where l_returnflag = 'N' and l_linenumber <> 1) as forbidden from lineitem where l_quantity > 10 group by 1),
s as (select p_partkey as work, case when p_size % 2 = 0 then 'published' else 'staged' end as status from part where p_retailprice >= 0 and p_partkey % 9 <> 0)"""


@query(f"""with {_RECONCILE}, j as (select coalesce(w.work, s.work) as work, w.work as ww, s.work as sw, status, served, clean, forbidden from w full join s on w.work = s.work)
select work, case when ww is null then 'published-workless' when sw is null then case when served > 0 then 'no-source-serving' else 'inert-orphan' end when status = 'published' and clean > 0 then 'published-not-fully-served'
when status = 'published' and forbidden > 0 then 'deferred' when status = 'published' then 'published-served' when served > 0 then 'unpublished-serving' else 'unpublished-unserved' end as class from j where ww is not null or status = 'published'""")
def served_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by whether what they serve fits their status."""
    flag, first = F.col("l_returnflag") == "N", F.col("l_linenumber") == 1
    works = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("rows"), F.count_if(~flag).alias("served"), F.count_if(flag & first).alias("unserved_clean"), F.count_if(flag & ~first).alias("unserved_forbidden"))
    sources = table(spark, sf_dir, "part").where("p_retailprice >= 0 and p_partkey % 9 <> 0").select(F.col("p_partkey").alias("work"), F.when(F.col("p_size") % 2 == 0, "published").otherwise("staged").alias("status"))
    return G.reconciled(works, sources)


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as l from documents), t as (select doc_id, regexp_replace(regexp_replace(l, '^[\s\x0B]+', ''), '[\s\x0B]+$', '') as t from l),
s as (select doc_id, t, regexp_replace(t, '[\s\x0B]+', '', 'g') as solid, string_split_regex(t, '[\s\x0B]+') as w from t),
g as (select doc_id, t <> '' as filled, t <> '' and (len(list_filter(range(1, 1 + greatest(0, length(t) - 4)), lambda i: not regexp_matches(t[i:i], '[A-Za-z0-9_]') and t[i:(i + 4)] = repeat(t[i:i], 5))) > 0
 or (length(solid) >= 4 and length(regexp_replace(solid, '[^a-zA-ZÀ-ɏͰ-Ͽἀ-῿]', '', 'g')) / length(solid) < 0.45) or len(list_filter(w, lambda x: length(x) >= 3 and regexp_matches(lower(x), '[a-z][0-9]|[0-9][a-z]'))) >= 2) as bad from s)
select doc_id, count(*) filter (where filled) as n_lines, count(*) filter (where bad) as n_garbage, round(case when count(*) filter (where filled) = 0 then 1 else count(*) filter (where bad) / count(*) filter (where filled) end, 6) as rate from g group by 1""")
def ocr_garbage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    filled, bad = F.count_if(F.regexp_replace("line", r"\s+", "") != ""), F.count_if(G.garbage_line(F.col("line")))
    n = lines.groupBy("doc_id").agg(filled.alias("n_lines"), bad.alias("n_garbage"))
    return n.withColumn("rate", F.when(F.col("n_lines") == 0, 1.0).otherwise(F.round(F.col("n_garbage") / F.col("n_lines"), 6)))


@query(r"""with l as (select source, doc_id, unnest(list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10)))))) as x from documents),
t as (select source, doc_id, x[2] as p, regexp_replace(regexp_replace(x[1], '^[\s\x0B]+', ''), '[\s\x0B]+$', '') as t from l),
n as (select *, count(*) over (partition by source, t) as n, coalesce(lag(t) over (partition by source order by doc_id, p), '') = '' and coalesce(lead(t) over (partition by source order by doc_id, p), '') = '' as alone from t)
select source, case when t = '' then 'blank' when length(t) <= 42 and n >= 10 then 'frequent' when regexp_full_match(t, '[0-9]{1,4}') then 'page_number' when alone and length(t) <= 32 and len(string_split_regex(t, '[\s\x0B]+')) <= 3 and not starts_with(t, 'Entry') then 'guide' else 'kept' end as class, count(*) as n_lines from n group by 1, 2""")
def page_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each source by what they are: page furniture by how often it comes, guide words by standing alone, and the rest."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    marked = G.without_chrome(lines, ["source"], F.trim("line").startswith("Entry"), unit="doc_id")
    return marked.groupBy("source", "class").agg(F.count("*").alias("n_lines"))


@query("""with v as (select p_partkey, ['zeta', 'theta', 'gamma', 'omega', 'lambda'][(p_partkey % 5 + 1)::int] as lemma, p_partkey % 3 as damage from part)
select p_partkey, case when damage < 2 then lemma end as lemma, case when damage < 2 then damage end as distance from v""")
def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned headwords looked up by the skeleton of confused characters: whole, with one character more, and unknown."""
    words = ["zeta", "theta", "gamma", "omega", "lambda"]
    vocabulary = spark.createDataFrame([(w, w) for w in words], "lemma string, form string")
    scanned = {"zeta": "{eta", "theta": "th€ta", "gamma": "yamma", "omega": "ome8a".replace("8", "g"), "lambda": "iambda"}
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 5 + 1).cast("int"))
    key = F.when(F.col("p_partkey") % 3 == 0, pick([scanned[w] for w in words])).when(F.col("p_partkey") % 3 == 1, F.concat(pick([scanned[w] for w in words]), F.lit("x"))).otherwise("qqqqqqqqqqq")
    return G.recognised(table(spark, sf_dir, "part").select("p_partkey", key.alias("key")), vocabulary).select("p_partkey", "lemma", "distance")


@query("""select o_orderkey, case o_orderkey % 8 when 0 then 'apparatus-title' when 1 then 'apparatus-title' when 2 then 'roman-numeral-body' when 3 then 'word-index-title' when 4 then 'publisher-price-list-body' when 6 then 'apparatus-title' end as kind,
case o_orderkey % 8 when 0 then 'strong' when 1 then 'weak' when 2 then 'strong' when 3 then 'strong' when 4 then 'strong' when 6 then 'strong' end as strength from orders""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are front matter, and sentences that only use such words."""
    k = F.col("o_orderkey") % 8
    prices = "\n".join(["POEMS            5 0", "---- MORE", "6s. 6d.", "$1.50", "20 cents", "ODES    2 6"])
    heading = F.when(k == 0, "The Argument.").when(k == 1, "The Preface to the Lord's Prayer").when(k == 3, "Index of Latin and Greek Words and Phrases")
    body = F.when(k == 2, "I. II. xiv. — XXI").when(k == 4, prices).when(k == 5, "The introduction of the Word as pre-existent is the burden of these first verses, and so on.").when(k == 6, "Preface to the Gospel of John\nSome text").otherwise("In this preface Paul says much.")
    return G.front_matter(table(spark, sf_dir, "orders").select("o_orderkey", heading.alias("heading"), body.alias("body"))).select("o_orderkey", "kind", "strength")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'JOHN' when 1 then 'LUKE' when 2 then 'MARK' end as gospel, case o_orderkey % 4 when 0 then 3 when 1 then 1 end as volume, o_orderkey % 4 in (0) as agrees from orders""")
def title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gospel and volume a scan's title page names, by votes, and whether it may be the third volume on John."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "NOTES ON ST. JOHN, VOL. III. as ST. LUKE says ST. JOHN. VOL. III").when(k == 1, "ST. LUKE VOL. I and ST. JOHN VOL. I, ST. LUKE VOL. I".replace("ST. JOHN VOL. I, ", "")).when(k == 2, "ST. MARK and ST. MARK, not ST. JOHN").otherwise("no title")
    found = G.gospel_votes(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")
    both = found.withColumn("other_gospel", F.lit("JOHN")).withColumn("other_volume", F.lit(3))
    return both.withColumn("agrees", G.titles_agree(both)).select("o_orderkey", "gospel", "volume", "agrees")


_MOVED = "served as (select o_orderkey, o_orderstatus, o_custkey from orders), kept as (select * from served where coalesce(o_orderstatus <> 'P', false)), moved as (select distinct * from served where not coalesce(o_orderstatus <> 'P', false))"


@query(f"with {_MOVED} select 'kept' as part, count(*) as n from kept union all select 'moved', count(*) from moved union all select 'restored', (select count(*) from kept) + (select count(*) from moved)")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may not stay, moved out once each, and back."""
    served = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    kept, moved = G.quarantined(served, served.where("o_orderstatus = 'P'").limit(0), F.col("o_orderstatus") != "P")
    back = G.restored(kept, moved)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(kept, "kept").unionByName(count(moved, "moved")).unionByName(count(back, "restored"))


@query("""with n as (select o_custkey % 50 as book, o_orderkey % 7 as chapter, 'A' || o_orderkey % 5 as author, null::varchar as work, case when o_orderkey % 2 = 0 then 'Reformed' end as tradition, (1500 + o_orderkey % 400)::int as year, (o_orderkey % 30)::int as verse_start, o_comment as text from (select *, repeat(o_orderpriority || ' ', 150) as o_comment from orders) where o_orderstatus <> 'P'),
x as (select o_custkey % 50 as book, o_orderkey % 7 as chapter, 'A' || o_orderkey % 11 as author, case when o_orderkey % 3 = 0 then 'w' end as work, o_orderpriority as tradition, null::int as year, (o_orderkey % 30)::int as verse_start, o_orderstatus as text from orders where o_orderstatus = 'P'),
f as (select book, chapter, author, work, coalesce(tradition, 'Patristic') as tradition, year, verse_start, case when length(text) > 1200 then regexp_replace(substring(text, 1, 1200), '\\s+\\S*$', '') || '…' else text end as text from n),
e as (select * from x where work is not null or (book, chapter, author) not in (select (book, chapter, author) from f) union all select * from f)
select book, chapter, author, count(*) as n, sum(length(text)) as n_chars from e group by 1, 2, 3""".replace("\\\\", "\\"))
def chapters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters put together from two sources, what belongs to works kept, long texts cut at a blank."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    common = lambda author, work, tradition, year, text: [(F.col("o_custkey") % 50).alias("book"), (k % 7).alias("chapter"), author.alias("author"), work.cast("string").alias("work"), tradition.alias("tradition"), year.cast("int").alias("year"), (k % 30).cast("int").alias("verse_start"), text.alias("text")]
    name = lambda n: F.concat(F.lit("A"), (k % n).cast("string"))
    long_text = F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(150))
    new = o.where("o_orderstatus <> 'P'").select(*common(name(5), F.lit(None), F.when(k % 2 == 0, "Reformed"), 1500 + k % 400, long_text))
    old = o.where("o_orderstatus = 'P'").select(*common(name(11), F.when(k % 3 == 0, "w"), F.col("o_orderpriority"), F.lit(None), F.col("o_orderstatus")))
    merged = G.merged_chapters(new, new.limit(0), old)
    return merged.groupBy("book", "chapter", "author").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_EXCERPT = f"""s as (select c_custkey, 's' || c_custkey as slug, c_mktsegment as source_type, case when c_custkey % 3 <> 0 then 'published' else 'staged' end as status, {_sql_list(_URLS)}[(c_custkey % 5 + 1)::int] as url, c_custkey % 7 <> 0 as in_manifest, case when c_custkey % 11 = 0 then 'x' end as quarantine,
case when c_custkey % 13 = 0 then 'skip' end as policy, c_custkey % 17 = 0 as dirty from customer), h as (select *, {_HOST} as host from s), v as (select *, {_DOMAIN} as d from h),
e as (select slug, source_type, case when status <> 'published' then 'other cohort' when not in_manifest then 'no manifest entry' when quarantine is not null then 'quarantined' when policy = 'skip' then 'skipped by manifest' when d is not null then 'source ' || d when dirty then 'forbidden rows' else 'eligible' end as reason from v)"""


def _eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    sources = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), k.cast("string")).alias("slug"), F.col("c_mktsegment").alias("source_type"), F.when(k % 3 != 0, "published").otherwise("staged").alias("status"), F.element_at(F.array(*map(F.lit, _URLS)), (k % 5 + 1).cast("int")).alias("url"),
        (k % 7 != 0).alias("in_manifest"), F.when(k % 11 == 0, "x").alias("quarantine"), F.when(k % 13 == 0, "skip").alias("policy"), F.lit("https://ok.example").alias("manifest_url"), F.when(k % 17 == 0, 2).otherwise(0).alias("forbidden_rows"),
    )
    return G.excerpt_eligibility(sources)


@query(f"with {_EXCERPT} select slug, reason = 'eligible' as eligible, reason from e")
def excerpt_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligibility(spark, sf_dir).select("slug", "eligible", "reason")


@query(f"with {_EXCERPT} select min(slug) as slug, source_type from e where reason = 'eligible' group by 2 order by slug limit 3")
def excerpt_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.picked_excerpts(_eligibility(spark, sf_dir))


@query(f"""with {_SERVED}, w as (select l_suppkey, author, host, case when {_VETO} then 'author' when {_DOMAIN} is not null then 'provenance' end as why from h)
select coalesce(why, 'admitted') as rule, count(*) as n from w group by 1""")
def anchors_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that count, and those dropped by each rule."""
    good, dropped = G.admitted_anchors(_served(spark, sf_dir))
    return good.agg(F.count("*").alias("n")).select(F.lit("admitted").alias("rule"), "n").unionByName(dropped)


@query("select source, count(*) as n, count(*) filter (where regexp_matches(text, '[A-Za-z]{3}[0-9]')) as n_bad, round(count(*) filter (where regexp_matches(text, '[A-Za-z]{3}[0-9]')) / count(*), 6) as share from documents group by 1 order by count(*) filter (where regexp_matches(text, '[A-Za-z]{3}[0-9]')) / count(*) desc, source limit 25")
def defect_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.defect_share(table(spark, sf_dir, "documents"), "source", "[A-Za-z]{3}[0-9]").withColumn("share", F.round("share", 6))


@query("""with o as (select l_suppkey, l_orderkey * 10 + l_linenumber as k, l_quantity from lineitem)
select l_suppkey, k, 'head' as "where" from o qualify row_number() over (partition by l_suppkey order by k) <= 3 union all select l_suppkey, k, 'tail' from o qualify row_number() over (partition by l_suppkey order by k desc) <= 3 union all select l_suppkey, k, 'mark' from o where l_quantity >= 50""")
def head_tail_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity")
    return G.ends_and_marks(rows, "l_suppkey", "k", F.col("l_quantity") >= 50, 3).select("l_suppkey", "k", "where")


@query("select doc_id, list_filter(['Latin', 'licen[cs]e'], lambda m: not regexp_matches(substring(text, 1, 60000), m)) is not null as checked, len(list_filter(['Latin', 'licen[cs]e'], lambda m: not regexp_matches(substring(text, 1, 60000), m))) as n_missing from documents where len(list_filter(['Latin', 'licen[cs]e'], lambda m: not regexp_matches(substring(text, 1, 60000), m))) > 0")
def edition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose front matter lacks a marker of the edition they should be."""
    found = G.edition_faults(table(spark, sf_dir, "documents").select("doc_id", "text"), ["Latin", "licen[cs]e"])
    return found.select("doc_id", F.lit(True).alias("checked"), F.size("missing").cast("long").alias("n_missing"))
