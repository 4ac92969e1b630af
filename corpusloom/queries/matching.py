"""Queries on shared passages and scanned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import fnv1a32, ocr_tokens, shingles, stem_english, tokens
from corpusloom.operators import edits, editions, matching
from corpusloom.queries.registry import query
from corpusloom.session import table

#: SQL for ocr_tokens and shingle rows, in DuckDB's words.
_TOKENS = r"""
  list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(array_to_string(list_filter(
    string_split_regex(regexp_replace(text, '([A-Za-z])-[ \t]*\r?\n[ \t]*([A-Za-z])', '\1\2', 'g'), '\r?\n'),
    lambda l: not (length(regexp_replace(l, '[^A-Za-z]', '', 'g')) >= 4 and not regexp_matches(regexp_replace(l, '[^A-Za-z]', '', 'g'), '[a-z]'))), ' ')),
    '&#x?[0-9a-f]+;', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '' and not regexp_matches(t, '^[0-9]+$'))"""


def _shingles(relation: str, key: str, n: int, where: str = "true") -> str:
    return f"""(select distinct {key}, array_to_string(list_slice(t, i, i + {n - 1}), ' ') as shingle
      from (select {key}, t, unnest(generate_series(1, len(t) - {n - 1})) as i from (select {key}, {_TOKENS} as t from {relation} where {where})))"""


_HITS = f"""
with b as {_shingles("benchmark", "item_id", 6)}, d as {_shingles("documents", "doc_id", 6)},
own as (select item_id from b group by 1 having count(*) >= 3),
hits as (select doc_id, item_id, count(*) as hits from d join b using (shingle) where item_id in (select item_id from own) group by 1, 2 having count(*) >= 3)
"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.stored_passages(table(spark, sf_dir, "benchmark"), "item_id")


@query(_HITS + "select doc_id, item_id, hits, source from hits join (select doc_id, source from documents) using (doc_id)")
def uncited_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = matching.uncited_matches(table(spark, sf_dir, "documents"), _passages(spark, sf_dir), "doc_id", "item_id", carry=("source",))
    return hits.select("doc_id", "item_id", "hits", "source")


@query(_HITS + """, e as (select doc_id, item_id, 1::bigint as hits, 1.0::double as confidence, 'explicit' as channel from documents cross join (select 0::bigint as item_id) where contains(lower(text), 'licensed under')),
u as (select doc_id, item_id, hits, 0.5::double as confidence, 'uncited' as channel from hits)
select doc_id, item_id, channel, hits, confidence from (select * from e union all select doc_id, item_id, hits, confidence, channel from u)
qualify row_number() over (partition by doc_id, item_id, channel order by hits desc, confidence desc) = 1""")
def anchor_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = matching.uncited_matches(docs, _passages(spark, sf_dir), "doc_id", "item_id").withColumn("confidence", F.lit(0.5))
    cited = docs.where(F.contains(F.lower("text"), F.lit("licensed under"))).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(1).cast("long").alias("hits"), F.lit(1.0).alias("confidence"))
    return matching.anchors(cited, found, ["doc_id", "item_id"]).select("doc_id", "item_id", "channel", "hits", "confidence")


@query(f"""
with i as (select distinct 'e' || item_id % 3 as edition, shingle from {_shingles("benchmark", "item_id", 4)}), d as {_shingles("documents", "doc_id", 4)},
total as (select doc_id, count(*) as total from d where shingle in (select shingle from i) group by 1),
c as (select doc_id, edition, count(*) as hits from d join i using (shingle) group by 1, 2),
w as (select * from c qualify row_number() over (partition by doc_id order by hits desc, edition) = 1)
select documents.doc_id as doc_id, case when total >= 25 then edition else 'none' end as edition, coalesce(hits, 0) as hits, coalesce(total, 0) as total,
  round(case when total >= 25 then greatest(0.5, least(1.0, hits / total)) else 0.5 end, 6) as confidence from documents left join w using (doc_id) left join total using (doc_id)""")
def lang_detect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three editions each document quotes; most quote none often enough."""
    editions = table(spark, sf_dir, "benchmark").select("text", F.concat(F.lit("e"), (F.col("item_id") % 3).cast("string")).alias("edition"))
    found = matching.votes(table(spark, sf_dir, "documents"), editions, "doc_id", "edition", n=4)
    return found.withColumn("confidence", F.round("confidence", 6))


_PAIRS = f"""
with d as {_shingles("documents", "doc_id", 6)}, b as {_shingles("benchmark", "item_id", 6)},
nd as (select doc_id, count(*) as n_left from d group by 1), nb as (select item_id, count(*) as n_right from b group by 1),
c as (select doc_id, item_id, count(*) as common from d join b using (shingle) group by 1, 2),
p as (select doc_id, item_id, common, n_left, n_right, round(common / (n_left + n_right - common), 6) as jaccard, round(common / least(n_left, n_right), 6) as containment
  from c join nd using (doc_id) join nb using (item_id))
"""


@query(_PAIRS + "select * from p")
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 6)
    return pairs.withColumn("jaccard", F.round("jaccard", 6)).withColumn("containment", F.round("containment", 6))


@query(_PAIRS + "select case when jaccard >= 0.9 then 'match' when containment >= 0.9 then 'truncated' else 'differ' end as class, count(*) as n from p group by 1")
def containment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.classified(shingle_jaccard_pairs(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


@query(r"""select lang, count(*) as n_docs, sum(len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''))) as n_tokens from documents group by 1""")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(tokens(F.col("text")))).alias("n_tokens"))


_K = f"""
with d as {_shingles("documents", "doc_id", 6)}, b as {_shingles("benchmark", "item_id", 6)},
g as (select distinct doc_id, item_id from {_shingles("documents", "doc_id", 8)} join {_shingles("benchmark", "item_id", 8)} using (shingle)),
c as (select doc_id, item_id, count(*) as hits from d join b using (shingle) group by 1, 2),
m as (select coalesce(c.doc_id, g.doc_id) as doc_id, coalesce(c.item_id, g.item_id) as item_id, coalesce(hits, 0) as hits, g.doc_id is not null as gold from c full join g on c.doc_id = g.doc_id and c.item_id = g.item_id)
select k::int as k, count(*) filter (where hits >= k and gold) as true_positives, count(*) filter (where hits >= k and not gold) as false_positives, count(*) filter (where hits < k and gold) as misses
from m, generate_series(1, 8) as t(k) group by 1"""


@query(_K)
def match_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each least number of common 6-grams: agreement with pairs that share an 8-gram."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    own, of = (matching.shingle_rows_of_two(df, key, 6, 8) for df, key in ((docs, "doc_id"), (items, "item_id")))
    long = of.withColumn("long", F.size(F.split("shingle", " ")) == 8)
    both = own.join(long, "shingle").groupBy("doc_id", "item_id").agg(F.count_if(~F.col("long")).alias("hits"), F.bool_or("long").alias("gold"))
    counted = both.select("hits", "gold", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"))
    over, gold_ = F.col("hits") >= F.col("k"), F.col("gold")
    return counted.groupBy("k").agg(F.count_if(over & gold_).alias("true_positives"), F.count_if(over & ~gold_).alias("false_positives"), F.count_if(~over & gold_).alias("misses"))


_COVERED = f"""e as (select distinct lang, item_id, shingle from {_shingles("documents", "doc_id, lang", 6)} join {_shingles("benchmark", "item_id", 6)} using (shingle)),
n as (select lang, item_id, count(*) as n from e group by 1, 2),
c as (select a.lang as lang, b.lang as other, a.item_id as item_id, count(*) as common from e a join e b on a.item_id = b.item_id and a.shingle = b.shingle and a.lang < b.lang group by 1, 2, 3),
l as (select x.lang as edition, y.lang as other, count(*) as n_passages, avg(coalesce(common, 0) / (x.n + y.n - coalesce(common, 0))) as likeness
  from n x join n y on x.item_id = y.item_id and x.lang < y.lang left join c on c.lang = x.lang and c.other = y.lang and c.item_id = x.item_id group by 1, 2)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each language's documents hold of each passage: its shingles, as if they were an edition of the passages."""
    own = table(spark, sf_dir, "documents").select("lang", F.explode(shingles(ocr_tokens(F.col("text")), 6)).alias("shingle"))
    of = matching.shingle_rows(table(spark, sf_dir, "benchmark"), "item_id", 6)
    return own.join(of, "shingle").select(F.col("lang").alias("edition"), F.col("item_id").alias("passage"), "shingle").distinct()


@query(f"with {_COVERED} select edition, other, n_passages, round(likeness, 6) as likeness from l")
def edition_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike editions are in the passages that both have: the mean of common by united shingles, from masks of editions."""
    return editions.likeness(_covered(spark, sf_dir)).withColumn("likeness", F.round("likeness", 6))


@query(f"""with recursive {_COVERED}, u as (select edition as a, other as b from l where likeness >= 0.02 union all select other, edition from l where likeness >= 0.02),
r(node, seen) as (select distinct lang, lang from e union select r.node, u.b from r join u on u.a = r.seen), f as (select node, min(seen) as family from r group by 1),
d as (select distinct family, shingle from e join f on e.lang = f.node), s as (select family, node, count(distinct shingle) as n from e join f on e.lang = f.node group by 1, 2)
select f.node as edition, f.family as family, (select count(*) from d where d.family = f.family) as united, (select max(n) from s where s.family = f.family) as largest,
round((select count(*) from d where d.family = f.family) / (select max(n) from s where s.family = f.family), 6) as cost from f""")
def edition_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of alike editions, and what uniting a family's shingles costs against its richest edition."""
    return editions.families(_covered(spark, sf_dir), 0.02).withColumn("cost", F.round("cost", 6))


@query(r"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents), v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as known from benchmark),
p as (select word, known, levenshtein(word, known) as distance from w join v on abs(length(word) - length(known)) <= 2 where levenshtein(word, known) <= case when length(word) <= 3 then 0 when length(word) <= 6 then 1 else 2 end)
select word, count(*) as n, arg_min(known, (distance, length(known), known)) as nearest, min(distance) as distance from p group by 1""")
def word_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the nearest known word within the edits that its length allows."""
    words = lambda name, to: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias(to)).distinct()
    n = F.length("word")
    own = words("documents", "word").withColumn("edits", F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2))
    found = edits.near(own, words("benchmark", "known"), "word", "known", "edits")
    best = F.min(F.struct("distance", F.length("known").alias("n"), "known"))
    return found.groupBy("word").agg(F.count("*").alias("n"), best.alias("b")).select("word", "n", F.col("b.known").alias("nearest"), F.col("b.distance").alias("distance"))


@query(r"""
with t as (select unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as token from documents),
known as (select distinct unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as token from benchmark)
select token, count(*) as n from t where token not in (select token from known) group by 1 order by n desc, token limit 20""")
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest capitalised tokens that the known texts lack."""
    found = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 0)).alias("token"))
    known = found(table(spark, sf_dir, "benchmark")).distinct()
    counts = found(table(spark, sf_dir, "documents")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(known, "token", "left_anti").orderBy(F.desc("n"), "token").limit(20)


@query(r"""
with w as (select distinct unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as word from benchmark)
select word, case when word like '%eth' and length(word) > 4 or word like '%est' and length(word) > 4 then left(word, length(word) - 3) when word like '%ies' and length(word) > 4 then left(word, length(word) - 3) || 'y'
  when word like '%ing' and length(word) > 4 then left(word, length(word) - 3) when word like '%ed' and length(word) > 4 then left(word, length(word) - 2) when word like '%es' and length(word) > 3 then left(word, length(word) - 2)
  when word like '%s' and word not like '%ss' and length(word) > 3 then left(word, length(word) - 1) else word end as stem
from w where word <> ''""")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem_english(F.col("word")).alias("stem"))


@query(f"""with b as {_shingles("benchmark", "item_id", 6)}
select item_id, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(shingle, ''), lambda c: ascii(c)::hugeint)), lambda h, c: (xor(h::bigint, c::bigint)::hugeint * 16777619) % 4294967296)::bigint as hash from b""")
def shingle_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit hashes of the benchmark's shingles."""
    rows = matching.shingle_rows(table(spark, sf_dir, "benchmark"), "item_id", 6)
    return rows.select("item_id", fnv1a32(F.col("shingle")).alias("hash"))
