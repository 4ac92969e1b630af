"""Full-text search over documents, turns and parts: questions as typed, ranks, pages with excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import serving
from corpusloom.operators import fulltext as T
from corpusloom.operators import postings as P
from corpusloom.operators.relational import best_of, capped_count
from corpusloom.queries.registry import query
from corpusloom.queries.serving import _AUTHORS, _CLEAN, _URLS, _VETO, _WHOLE, _sql_list
from corpusloom.session import table

# As the library cuts words: numeric entities and tags are blanked first.
_CUT = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '&#x?[0-9a-f]+;', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_W = f"with w as (select *, {_CUT} as words from documents)"
_QUESTION = '"of the" -der OR licensed under'


def documents_index(spark: SparkSession, sf_dir: str, config: str = "simple") -> P.TextIndex:
    return P.stored(table(spark, sf_dir, "documents"), ("doc_id",), F.col("text"), ("source", "lang"), config)


def _turns_index(spark: SparkSession, sf_dir: str) -> P.TextIndex:
    return P.stored(table(spark, sf_dir, "conversations"), ("conv_id", "turn"), F.col("text"), ("role",))


def _found(spark: SparkSession, sf_dir: str, question: str | T.Node, config: str = "simple", **more: object) -> P.Found:
    """Documents that fit, from the stored index."""
    return P.search(documents_index(spark, sf_dir, config), spark, question, **more)


@query(_W + """ select doc_id from w where (contains(' ' || array_to_string(words, ' ') || ' ', ' of the ') and not list_contains(words, 'der')) or (list_contains(words, 'licensed') and list_contains(words, 'under'))""")
def fts_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase without a word, or two words."""
    return _found(spark, sf_dir, _QUESTION).rows.select("doc_id")


_SUM = lambda term: f"list_sum(list_transform(range(1, len(list_filter(words, lambda x: x = '{term}')) + 1), lambda j: 0.1 / (j * j)))"


@query(_W + f""" select doc_id, round((coalesce({_SUM('license')}, 0) + coalesce({_SUM('license2')}, 0) + coalesce({_SUM('the')}, 0)) / 1.6449340668482264 / 3, 8) as rank from w
where list_contains(words, 'license') or list_contains(words, 'license2') or list_contains(words, 'the') order by rank desc, doc_id limit 50""")
def fts_or_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = T.parsed("license or license2 or the")
    found = _found(spark, sf_dir, node)
    return found.rows.select("doc_id", F.round(P.rank(found, node), 8).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(50)


_OCCURS = """, o as (select doc_id, source, unnest(list_transform(list_zip(words, range(1, len(words) + 1)), lambda x: {'w': x[1], 'p': x[2]})) as x from w where list_contains(words, 'the') and list_contains(words, 'license')),
q as (select doc_id, source, x.p as p, x.w as t from o where x.w in ('the', 'license')),
g as (select doc_id, source, p, t, lag(p) over (partition by doc_id order by p) as lp, lag(t) over (partition by doc_id order by p) as lt from q),
r as (select doc_id, any_value(source) as source, round(sum(case when t <> lt then 0.1 / (p - lp) end), 8) as rank from g group by 1)"""


@query(_W + _OCCURS + " select doc_id, rank from r order by rank desc, doc_id limit 50")
def fts_cover_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words by cover density: covers are neighbouring occurrences of one and the other."""
    node = T.parsed("the license")
    found = _found(spark, sf_dir, node)
    return found.rows.select("doc_id", F.round(P.cover_rank(found, node), 8).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(50)


@query(_W + """, q as (select doc_id, list_filter(list_transform(range(1, len(words) + 1), lambda i: case when words[i] = 'license' then i end), lambda i: i is not null) as a,
 list_filter(list_transform(range(1, len(words) + 1), lambda i: case when words[i] = 'licensed' then i end), lambda i: i is not null) as b from w where list_contains(words, 'license') and list_contains(words, 'licensed')),
p as (select doc_id, abs(x - y) as d from (select doc_id, unnest(a) as x, b from q) t, unnest(b) u(y)),
r as (select doc_id, 1 - exp(sum(ln(1 - sqrt(0.01 * case when d > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) end)))) as rank from p group by 1)
select doc_id, round(case when rank > 0 then rank else 1e-20 end, 6) as rank from r""")
def fts_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words by how near their occurrences are."""
    node = T.parsed("license licensed")
    found = _found(spark, sf_dir, node)
    return found.rows.select("doc_id", F.round(P.rank(found, node), 6).alias("rank"))


_PAGE = T.parsed("the license")


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each source for a question, ranked on places alone."""
    found = _found(spark, sf_dir, _PAGE, columns=("source",))
    ranked = best_of(found.rows.select("source", "doc_id", F.round(P.cover_rank(found, _PAGE), 8).alias("rank")), ["source"], [F.desc("rank"), F.asc("doc_id")])
    return ranked.orderBy(F.desc("rank"), "doc_id").limit(20)


@query(_W + _OCCURS + " select source, doc_id, rank from r qualify row_number() over (partition by source order by rank desc, doc_id) = 1 order by rank desc, doc_id limit 20")
def fts_works_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir).select("source", "doc_id", "rank")


@query()
def fts_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page with its excerpts: the texts of its 20 rows are joined to it, and no other is read into the search."""
    page = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(_page(spark, sf_dir)), "doc_id")
    return T.headlines(page, _PAGE).select("source", "doc_id", "snippet")


@query()
def fts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question by English stems, without common words; SQL here has no such stemmer."""
    node = T.parsed("licensing the versions", "english")
    found = _found(spark, sf_dir, node, "english")
    return found.rows.select("doc_id", F.round(P.rank(found, node), 8).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(50)


@query(_W + " select doc_id, lang from w where lang in ('de', 'fr') and list_contains(words, 'license') order by len(list_filter(words, lambda x: x = 'license')) desc, doc_id limit 20")
def fts_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search within some kinds of works only: the fence stands on the index's own columns."""
    node = T.parsed("license")
    found = _found(spark, sf_dir, node, where=F.col("lang").isin("de", "fr"), columns=("lang",))
    return found.rows.select("doc_id", "lang", P.rank(found, node).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(20).select("doc_id", "lang")


_ENTRIES = f"""e as (select doc_id, words, {_sql_list(_AUTHORS)}[(doc_id % 8 + 1)::int] as author, {_sql_list(_URLS)}[(doc_id % 5 + 1)::int] as url, doc_id % 66 as book from w)"""


def _legal_entries(spark: SparkSession, sf_dir: str, question: str) -> tuple[P.Found, Column]:
    """Documents that fit and may be found, and their authors."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    author = pick(_AUTHORS, 8)
    return _found(spark, sf_dir, question, where=serving.searchable(author, F.col("doc_id") % 66, pick(_URLS, 5))), author


@query(f"{_W}, {_ENTRIES}, f as (select doc_id from e where list_contains(words, 'the') and {_WHOLE} and {_CLEAN} and not {_VETO}) select least(count(*), 1000)::bigint as total, count(*) >= 1000 as capped from f")
def fts_commentary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries that may be found fit, counted up to a cap."""
    return capped_count(_legal_entries(spark, sf_dir, "the")[0].rows)


@query(f"{_W}, {_ENTRIES} select doc_id, author from e where list_contains(words, 'the') and {_WHOLE} and {_CLEAN} and not {_VETO} order by len(list_filter(words, lambda x: x = 'the')) desc, doc_id limit 25")
def fts_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, author = _legal_entries(spark, sf_dir, "the")
    return found.rows.select("doc_id", author.alias("author"), F.size(found.at("the")).alias("n")).orderBy(F.desc("n"), "doc_id").limit(25).select("doc_id", "author")


_T = f"with w as (select *, {_CUT} as words from conversations)"


@query(_T + """, f as (select conv_id, turn, role, len(list_filter(words, lambda x: x = 'the')) as n from w where list_contains(words, 'the'))
select conv_id, turn, case when role = 'user' then 'tombstone' else 'snippet' end as state from f qualify row_number() over (partition by conv_id order by n desc, turn) = 1""")
def study_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best block of each study; what may be shown of it is settled before an excerpt of any is made."""
    node = T.parsed("the")
    found = P.search(_turns_index(spark, sf_dir), spark, node, columns=("role",))
    best = best_of(found.rows.select("conv_id", "turn", "role", P.rank(found, node).alias("rank")), ["conv_id"], [F.desc("rank"), F.asc("turn")])
    return best.select("conv_id", "turn", F.when(F.col("role") == "user", "tombstone").otherwise("snippet").alias("state"))


@query(_T + """ select conv_id, turn from w where role = 'user' and list_contains(words, 'the') and not list_contains(words, 'and') order by len(list_filter(words, lambda x: x = 'the')) desc, conv_id, turn limit 30""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own lines."""
    node = T.parsed("the -and")
    found = P.search(_turns_index(spark, sf_dir), spark, node, where=F.col("role") == "user")
    return found.rows.select("conv_id", "turn", P.rank(found, node).alias("rank")).orderBy(F.desc("rank"), "conv_id", "turn").limit(30).select("conv_id", "turn")


@query("""with p as (select p_partkey, p_type, string_split(lower(p_type), ' ') as h, string_split(lower(p_name), ' ') as b from part),
n as (select l_partkey, count(*) as n from lineitem group by 1)
select p_partkey, p_type, coalesce(n, 0) as entries from p left join n on l_partkey = p_partkey where list_contains(h, 'promo') or list_contains(b, 'promo') order by (lower(p_type) = 'promo') desc, list_contains(h, 'promo') desc, p_partkey limit 10""")
def topic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by exact heading first, then by words of the heading, then of the body, with how many entries each has."""
    node = T.parsed("promo")
    p = table(spark, sf_dir, "part").withColumn("body", F.concat_ws(" ", "p_type", "p_name"))
    found = T.matches(p, node, text="body").withColumn("head", F.split(F.lower("p_type"), " "))
    order = [F.desc(F.lower("p_type") == "promo"), F.desc(T.rank(F.col("head"), node)), F.asc("p_partkey")]
    page = found.orderBy(*order).limit(10)
    n = table(spark, sf_dir, "lineitem").join(F.broadcast(page.select(F.col("p_partkey").alias("l_partkey"))), "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return page.join(n, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "p_type", F.coalesce("n", F.lit(0)).alias("entries"))
