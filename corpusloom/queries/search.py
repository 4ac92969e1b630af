"""Full-text search with plain words, snippets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_literal, window_around
from corpusloom.operators import postings as P
from corpusloom.operators.relational import best_of
from corpusloom.queries.fulltext import documents_index
from corpusloom.queries.registry import query
from corpusloom.session import table

_W = "with w as (select *, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as words from documents)"


@query(_W + " select doc_id from w where list_contains(words, 'the') and list_contains(words, 'and') and not list_contains(words, 'der')")
def fts_simple_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search(documents_index(spark, sf_dir), spark, "the and -der").rows.select("doc_id")


@query(_W + " select doc_id from w where contains(' ' || array_to_string(words, ' ') || ' ', ' of the ')")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search(documents_index(spark, sf_dir), spark, '"of the"').rows.select("doc_id")


_TF = ", t as (select doc_id, source, len(list_filter(words, lambda x: x = 'the')) as a, len(list_filter(words, lambda x: x = 'license')) as b from w where list_contains(words, 'the'))"


@query(_W + _TF + " select doc_id, round(a / (a + 1) + b / (b + 1), 6) as rank from t order by rank desc, doc_id limit 30")
def fts_simple_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.search(documents_index(spark, sf_dir), spark, "the", also=("license",))
    return found.rows.select("doc_id", F.round(P.frequency_rank(found, ["the", "license"]), 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(30)


@query(_W + _TF + """, b as (select source, doc_id, round(a / (a + 1) + b / (b + 1), 6) as rank from t qualify row_number() over (partition by source order by round(a / (a + 1) + b / (b + 1), 6) desc, doc_id) = 1)
select source, doc_id, rank, n_chars from b join documents using (doc_id, source)""")
def fts_units_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each source; what else is shown of it is joined to the few rows."""
    found = P.search(documents_index(spark, sf_dir), spark, "the", also=("license",), columns=("source",))
    scored = found.rows.select("source", "doc_id", F.round(P.frequency_rank(found, ["the", "license"]), 6).alias("rank"))
    best = best_of(scored, ["source"], [F.desc("rank"), F.asc("doc_id")])
    return best.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("source", "doc_id", "rank", "n_chars")


@query("""select conv_id, turn, substring(text, greatest(strpos(lower(text), 'the') - 138, 1), 280) as snippet from conversations where contains(lower(text), 'the')""")
def substring_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(contains_literal(F.col("text"), "the"))
    return rows.select("conv_id", "turn", window_around(F.col("text"), "the").alias("snippet"))


@query(r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'none') as ref, regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '(^|\.)example\.com$') as known from pages""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    ref = F.regexp_extract("url", "[?&]ref=([^&#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.when(ref == "", "none").otherwise(ref).alias("ref"), host.rlike(r"(^|\.)example\.com$").alias("known"))


@query(r"""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"')) as n_links, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) as n_text from pages""")
def html_text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \t\r\n]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("n_links"), F.length(text).cast("long").alias("n_text"))


@query(r"""with h as (select conv_id, turn, rule, len(list_distinct(regexp_extract_all(lower(text), pattern))) as n from conversations, (values ('the_words', 'the [a-z]+'), ('numbers', '[0-9]+'), ('shout', '[a-z]+!')) as r(rule, pattern))
select conv_id, turn, rule, n from h where n > 0""")
def screens_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different phrases of each turn that a rule finds."""
    rules = {"the_words": "(the [a-z]+)", "numbers": "([0-9]+)", "shout": "([a-z]+!)"}
    low = F.lower("text")
    found = F.array(*[F.struct(F.lit(rule).alias("rule"), F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(p), 1))).alias("n")) for rule, p in rules.items()])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(found)).where("n > 0")
