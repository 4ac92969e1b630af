"""Queries on pieces of texts, quotes and checked answers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.normalize import normalized, snapped_quote
from corpusloom.operators import chunking, contract
from corpusloom.queries.registry import query
from corpusloom.session import table


def _chunks(spark: SparkSession, sf_dir: str, cutter) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", cutter)


@query()
def chunk_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, partial(chunking.prose, most=1200))


@query()
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, partial(chunking.paragraphs, most=800))


@query()
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, partial(chunking.sentences, most=1200))


@query()
def chunk_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, chunking.narrative)


@query()
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalized("text")).alias("digest"))


@query()
def snap_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words as a quote of the turn before it, cut to what that turn holds."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", snapped_quote("text", "earlier").alias("kept"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document that quotes it; some name another work or show more than their anchor covers."""
    docs = table(spark, sf_dir, "documents")
    by = F.struct(F.col("source").alias("author"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("other").alias("work"), F.col("lang").alias("tradition"), F.lit("corpus").alias("origin"))
    span = lambda a, b: F.struct(F.lit(a).cast("long").alias("start"), b.cast("long").alias("end"))
    voice = F.struct(F.lit("voice").alias("type"), F.col("doc_id").alias("section_id"), by.alias("attribution"), F.col("text").alias("quote"), F.array(span(1001001, F.lit(1001005))).alias("anchors"))
    shown = F.struct(F.lit(1001002).alias("start"), (F.lit(1001002) + F.col("n_chars") % 8).alias("end"), F.lit("web").alias("translation"))
    passages = F.struct(F.lit("passages").alias("type"), F.array(shown).alias("items"))
    body = F.concat(F.lit('{"contract_version":"1.1","teacher":"t","blocks":['), F.to_json(voice), F.lit(","), F.to_json(passages), F.lit("]}"))
    return docs.select(F.col("doc_id").alias("response_id"), "source", body.alias("body"), F.lit(1).alias("n_sections"), F.array("lang").alias("traditions"))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(
        F.col("doc_id").alias("section_id"), F.lit("corpus").alias("origin"), F.col("text").alias("body"), F.lit(None).cast("string").alias("heading"),
        F.col("source").alias("author"), F.col("lang").alias("title"), F.col("lang").alias("tradition"), F.lit(1001001).alias("verse_start"), F.lit(1001010).alias("verse_end"),
    )
    sources = docs.select(F.col("doc_id").alias("source_id"), F.col("source").alias("author"))
    translations = spark.createDataFrame([("web", True)], "slug string, usable boolean")
    missing = spark.createDataFrame([], "translation string, verse_id long")
    return contract.violations(_answers(spark, sf_dir), sections, sources, translations, missing, {1: 50})


@query("""select doc_id as response_id, source, 1 as section_id, source as author, lang as work, 'user_library' as origin, 1001001 as "start", text as quote from documents""")
def contract_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose numbers are texts and whose attribution is mistyped, set right from the section they cite."""
    docs = table(spark, sf_dir, "documents")
    typed = F.struct(F.lit("Someone").alias("author"), F.lit("else").alias("work"), F.lit("corpus").alias("origin"))
    anchor = F.array(F.struct(F.lit(" 1001001 ").alias("start"), F.lit("1001005").alias("end")))
    voice = F.struct(F.lit("voice").alias("type"), F.lit("1").alias("section_id"), typed.alias("attribution"), F.col("text").alias("quote"), anchor.alias("anchors"))
    body = F.concat(F.lit('{"contract_version":"1.1","teacher":"t","blocks":['), F.to_json(voice), F.lit("]}"))
    sections = docs.select(F.col("doc_id").alias("response_id"), F.lit(1).alias("place"), F.col("source").alias("author"), F.col("lang").alias("work"), F.col("lang").alias("tradition"), F.lit("").alias("slug"), F.lit("user_library").alias("origin"), F.col("text").alias("body"))
    right = contract.normalized_answers(docs.select(F.col("doc_id").alias("response_id"), "source", body.alias("body")), sections)
    block = F.from_json("body", contract.ANSWER)["blocks"][0]
    return right.select("response_id", "source", block["section_id"].alias("section_id"), block["attribution"]["author"].alias("author"), block["attribution"]["work"].alias("work"), block["attribution"]["origin"].alias("origin"), block["anchors"][0]["start"].alias("start"), block["quote"].alias("quote"))


_V = """with d as (select doc_id as response_id, source, n_chars, text is null as lacking from documents),
v as (select response_id, null::int as block, 'schema' as check_ from d where lacking
union all select response_id, 0, 'attribution_work' from d where not lacking and n_chars % 2 <> 0
union all select response_id, 0, 'quote_verbatim' from documents join d on doc_id = response_id where regexp_full_match(text, '[\\s.,;:!?()\\[\\]{}"''–—…-]*')
union all select response_id, 1, 'passages_grounded' from d where not lacking and n_chars % 8 > 3) """


@query(_V + 'select response_id, block, check_ as "check" from v')
def contract_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).select("response_id", "block", "check")


@query(_V + """, f as (select distinct response_id from v)
select source, count(*) as n, count(*) filter (where f.response_id is null) as n_passed, round(count(*) filter (where f.response_id is null) / count(*), 6) as rate from d left join f using (response_id) group by 1""")
def contract_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.pass_rates(_answers(spark, sf_dir), _violations(spark, sf_dir), "source")
