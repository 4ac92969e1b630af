"""References in texts made from orders' keys, so that SQL can say by arithmetic what must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import references as R
from corpusloom.operators.ranges import chapter_slices
from corpusloom.operators.relational import spread
from corpusloom.operators.selection import overlaps_years
from corpusloom.queries.registry import query
from corpusloom.session import table

# Name as written, number, canonical name; all have 16 or more chapters.
_BOOKS = [("gen", 1, "Genesis"), ("I Sam.", 9, "1 Samuel"), ("ps", 19, "Psalms"), ("jn", 43, "John"), ("Rom", 45, "Romans"), ("apocalypse", 66, "Revelation")]


def _made(*parts: str) -> str:
    """SQL of orders with a book, chapter and verse each, and further columns."""
    pick = lambda i: "[" + ", ".join(repr(b[i]) if isinstance(b[i], str) else str(b[i]) for b in _BOOKS) + "][(o_orderkey % 6 + 1)::int]"
    return f"m as (select o_orderkey, {pick(0)} as written, {pick(1)} as book, {pick(2)} as name, o_custkey % 15 + 1 as c, o_custkey % 20 + 1 as v, o_orderkey % 5 as form from orders)" + "".join(f", {p}" for p in parts)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys, dealt over all cores: texts are made from them and read by rules that cost more than the scan."""
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), megabytes=1.0)


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in _BOOKS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", pick(0).alias("written"), pick(2).alias("name"), (F.col("o_custkey") % 15 + 1).alias("c"), (F.col("o_custkey") % 20 + 1).alias("v"), (F.col("o_orderkey") % 5).alias("form"))


def _text(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _parts() -> tuple[Column, Column, Column]:
    return F.col("c"), F.col("v"), F.col("written")


_AT = "(book * 1000000 + c * 1000 + v)"


@query(f"""with {_made()} select o_orderkey, form < 4 as ok, case form when 0 then name || ' ' || c || ':' || v when 1 then name || ' ' || c || ':' || v || '–' || (v + 3) when 2 then name || ' ' || c || ':' || v || 'ff' when 3 then name || ' ' || c || '–' || (c + 1) end as display,
case form when 0 then {_AT} when 1 then {_AT} when 2 then {_AT} when 3 then book * 1000000 + c * 1000 + 1 end as start, case form when 0 then {_AT} when 1 then {_AT} + 3 when 2 then book * 1000000 + c * 1000 + 999 when 3 then book * 1000000 + (c + 1) * 1000 + 999 end as "end" from m""")
def reference_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole strings in five forms: a verse, a range, a verse and what follows, chapters, and a backwards range, which is refused."""
    chapter, verse, written = _parts()
    form = F.col("form")
    text = (
        F.when(form == 0, _text(written, " ", chapter, " ", verse)).when(form == 1, _text(written, " ", chapter, ":", verse, "–", verse + 3)).when(form == 2, _text(written, chapter, ".", verse, "ff"))
        .when(form == 3, _text(" ", written, "  ", chapter, " - ", chapter + 1)).otherwise(_text(written, " ", chapter, ":", verse + 1, "-", verse))
    )
    got = _columns(spark, sf_dir).select("o_orderkey", R.reference(text).alias("r"))
    first = F.get("r.ranges", 0)
    return got.select("o_orderkey", F.col("r.ok").alias("ok"), F.col("r.display").alias("display"), first["start"].alias("start"), first["end"].alias("end"))


@query(f"""with {_made()} select o_orderkey, name || ' ' || c || ':' || v as display, {_AT} as start, {_AT} as "end", true as explicit from m
union all select o_orderkey, '1 Corinthians ' || (c % 10 + 1) || ':' || v || '–' || (v + 2), 46000000 + (c % 10 + 1) * 1000 + v, 46000000 + (c % 10 + 1) * 1000 + v + 2, false from m
union all select o_orderkey, 'Romans ' || c || ':' || (v + 1), 45000000 + c * 1000 + v + 1, 45000000 + c * 1000 + v + 1, true from m where form = 1 and book <> 45""")
def reference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in prose: with ordinals, digits written on to names, verses after a blank, and words that only look like one."""
    chapter, verse, written = _parts()
    m = _columns(spark, sf_dir)
    more = F.when((F.col("form") == 1) & (F.col("name") != "Romans"), _text(" So romans ", chapter, " ", verse + 1, " too.")).otherwise("")
    prose = _text("In chapter 3 and top 6 see ", F.col("name"), " ", chapter, ":", verse, ", and also 1Cor ", chapter % 10 + 1, ":", verse, "-", verse + 2, ". He had 3 dogs 4 cats.", more)
    found = m.select("o_orderkey", F.explode(R.references(prose)).alias("r"))
    return found.select("o_orderkey", "r.display", "r.start", "r.end", "r.explicit")


@query("""with o as (select o_orderkey, o_custkey % 15 + 1 as c from orders)
select o_orderkey, 1 as ordinal, 'Laws of' as label, 2000000 + c * 1000 + 14 as start, 2000000 + c * 1000 + 16 as "end" from o
union all select o_orderkey, 2, 'Laws of', 2000000 + c * 1000 + 27, 2000000 + c * 1000 + 31 from o
union all select o_orderkey, 3, 'Laws of', 2000000 + (c + 1) * 1000 + 1, 2000000 + (c + 1) * 1000 + 1 from o
union all select o_orderkey, 4, 'Laws of', 2000000 + (c + 1) * 1000 + 2, 2000000 + (c + 1) * 1000 + 2 from o
union all select o_orderkey, 5, 'A heading', 7000000 + c * 1000 + 1, 7000000 + c * 1000 + 999 from o
union all select o_orderkey, 6, 'A heading', 47008016, 47008016 from o""")
def topic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose later references inherit book and chapter, with labels from their line or one above."""
    chapter, verse, written = _parts()
    o = _orders(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") % 15 + 1).alias("c"))
    body = _text("- Laws of: Ex ", chapter, ":14-16, 27-31; ", chapter + 1, ":1, 2\nA heading:\nJud ", chapter, " 2 Co 8:16")
    return o.select("o_orderkey", F.inline(R.topic_entries(body)["entries"])).select("o_orderkey", "ordinal", "label", "start", "end")


_QUESTIONS = [
    ("What does john 3 16 say", [43003016], [43003016]), ("mark 5 points from winning", [41005001], []), ("mark 5 and the kingdom of god", [41005001], [41005001]),
    ("good shepherd insurance", [43010001], []), ("the parable of the good shepherd", [43010001], [43010001]), ("prodigal son and good samaritan", [42015011, 42010025], [42015011, 42010025]), ("a plain question", [], []),
]
_PLACES = ", ".join(f"({i}, {s}, {str(s in c).lower()})" for i, (_, n, c) in enumerate(_QUESTIONS) for s in n)


@query(f"select o_orderkey, start, certain from orders join (values {_PLACES}) t(q, start, certain) on q = o_orderkey % {len(_QUESTIONS)}")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that a question names, and whether they are surely meant."""
    q = F.element_at(F.array(*[F.lit(x[0]) for x in _QUESTIONS]), (F.col("o_orderkey") % len(_QUESTIONS) + 1).cast("int"))
    got = _orders(spark, sf_dir).select("o_orderkey", R.question_intent(q).alias("r"))
    return got.select("o_orderkey", F.explode("r.named").alias("n"), "r.certain").select("o_orderkey", F.col("n.start").alias("start"), F.array_contains("certain", F.col("n")).alias("certain"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_custkey when 1 then -o_custkey when 2 then -70 when 3 then null end as first, case o_orderkey % 4 when 0 then o_custkey when 1 then -o_custkey when 2 then o_custkey when 3 then null end as last,
coalesce(case o_orderkey % 4 when 0 then o_custkey between 50 and 90 when 1 then false when 2 then o_custkey >= 50 end, false) as overlaps from (select o_orderkey, o_custkey % 9999 + 1 as o_custkey from orders)""")
def stated_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that headings state with an era, and whether they overlap A.D. 50 to 90."""
    k, y = F.col("o_orderkey") % 4, F.col("o_custkey") % 9999 + 1  # years have four digits at most
    heading = F.when(k == 0, _text("Of A.D. ", y)).when(k == 1, _text("Kings, ", y, " B.C.")).when(k == 2, _text("From 70 BCE to A. D. ", y)).otherwise(_text("Chapter ", y))
    got = _orders(spark, sf_dir).select("o_orderkey", R.years_stated(heading).alias("y"))
    first, last = F.get("y", 0), F.get("y", 1)
    return got.select("o_orderkey", first.alias("first"), last.alias("last"), overlaps_years(first, last, R.asked_years("what happened A.D. 50-90")).alias("overlaps"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') end as date from orders""")
def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with a month's name, day before or after it; the thirtieth of February and numbers alone are none."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    head = F.when(k == 0, _text("Preached on ", F.date_format(d, "d"), "th ", F.date_format(d, "MMMM"), ", ", F.date_format(d, "yyyy"), ".")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.lit("30 February 1871")).otherwise("3/4/1871")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.stated_date(head).alias("date"))


@query("""select o_orderkey, unnest(case o_orderkey % 3 when 0 then ['caesar'] when 1 then ['jerusalem', 'council-of-nicaea', 'nicaea'] else ['judea'] end) as slug from orders""")
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as whole words: Caesarea is not Caesar, nor rome Rome."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "Caesar went to Caesarea, past rome").when(k == 1, "From Jerusalem to the Council of Nicaea").otherwise("Judaea and Nicelens")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(R.named_entities(text)).alias("slug"))


@query(f"""with {_made()} select o_orderkey, {_AT} as k, c <= 15 as legal, name || ' ' || c || ':' || v as shown from m""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys checked against the books' chapters and written out, by a join with the books (66 rows)."""
    books = F.broadcast(spark.createDataFrame([(b.number, b.name, b.chapters) for b in R.BOOKS], "book int, book_name string, chapters int"))
    numbers = F.element_at(F.array(*[F.lit(b[1]) for b in _BOOKS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    m = _columns(spark, sf_dir).withColumn("k", numbers * 1_000_000 + F.col("c") * 1000 + F.col("v")).withColumn("book", F.floor(F.col("k") / 1_000_000).cast("int"))
    chapter, verse = F.floor(F.col("k") / 1000).cast("int") % 1000, F.col("k") % 1000
    return m.join(books, "book").select("o_orderkey", "k", ((chapter >= 1) & (chapter <= F.col("chapters")) & (verse >= 1)).alias("legal"), _text(F.col("book_name"), " ", chapter, ":", verse).alias("shown"))


@query("""with r as (select o_orderkey as id, (o_custkey % 60 + 1) * 1000000 + 1000 + 5 as start, (o_custkey % 60 + 1) * 1000000 + (o_orderkey % 12 + 1) * 1000 + 7 as "end" from orders),
b as (select * from (values (1, 50), (2, 40), (3, 27), (4, 36)) t(book, chapters)), c as (select book, unnest(generate_series(1, chapters)) as chapter from b),
h as (select id, book, chapter, start, "end", count(*) over (partition by id) as total, row_number() over (partition by id order by book, chapter) as n from r join c on book * 1000 + chapter between start // 1000 and "end" // 1000 where "end" >= start)
select id, book, chapter, case when book * 1000 + chapter = start // 1000 then 5 else 1 end as from_verse, case when book * 1000 + chapter = "end" // 1000 then 7 else 999 end as to_verse, total > 8 as truncated, total from h where n <= 8""")
def range_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges as chapters, eight at most, with their ends clipped."""
    book = (F.col("o_custkey") % 60 + 1) * 1_000_000
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (book + 1005).alias("start"), (book + (F.col("o_orderkey") % 12 + 1) * 1000 + 7).alias("end"))
    return chapter_slices(r, spark.createDataFrame([(1, 50), (2, 40), (3, 27), (4, 36)], "book int, chapters int"))


@query("""with g as (select * from (values ('pentateuch', 1, 5, 187), ('gospels', 40, 43, 89), ('minor-prophets', 28, 39, 67), ('wisdom-literature', 18, 22, 243), ('pauline-epistles', 45, 57, 87), ('general-epistles', 59, 65, 21), ('whole-bible', 1, 66, 1189)) t(k, lo, hi, chapters))
select k as "group", hi - lo + 1 as n_books, chapters, count(o_orderkey) as n_anchors, count(distinct o_custkey % 66) as n_anchored from g left join orders on o_custkey % 66 + 1 between lo and hi group by all""")
def book_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups of books, a small fixed table, with the anchors in them and how many of their books have any; orders stand for anchors, counted by book before they meet the groups."""
    rows = [(key, b.number, b.chapters) for key in R.GROUPS for b in R.group_books(key)]
    groups = spark.createDataFrame(rows, "`group` string, book int, chapters int")
    anchors = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 66 + 1).alias("book")).agg(F.count("*").alias("n"))
    both = groups.join(anchors, "book", "left")
    return both.groupBy("group").agg(F.count("*").cast("int").alias("n_books"), F.sum("chapters").cast("int").alias("chapters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_anchors"), F.count("n").alias("n_anchored"))
