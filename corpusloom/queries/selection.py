"""Choices from ranked rows; labels of vectors stand for chapters or registers, vec_id modulo small numbers for authors and traditions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_literal
from corpusloom.operators import postings as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import selection as S
from corpusloom.operators import table_functions
from corpusloom.operators import vector_index as V
from corpusloom.operators.fixpoint import shared_dir
from corpusloom.operators.relational import best_of
from corpusloom.queries.fulltext import documents_index
from corpusloom.queries.registry import query
from corpusloom.queries.retrieval import _RANKED, _S, _query, _ranked
from corpusloom.session import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("score", R.cosine(F.col("embedding"), _query(spark, sf_dir))).drop("embedding")


@query(_RANKED + """, b as (select vec_id, label, vec_id % 5 as author, score from s), lead as (select label, min(rank) as major, arg_min(vec_id % 5, rank) as lead_author from r group by 1 order by major limit 3),
f as (select label, author, max_by(vec_id, (score, -vec_id)) as vec_id from b where label in (select label from lead) group by 1, 2),
g as (select f.*, major, row_number() over (partition by label order by author) as minor from f join lead using (label) where author is distinct from lead_author),
u as (select vec_id, label, rank as major, 0 as minor from r union all select vec_id, label, major, minor from g),
o as (select * from u qualify row_number() over (partition by vec_id order by major, minor) = 1)
select vec_id, label, row_number() over (order by major, minor) as place from o""")
def backfill_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More voices of the leading chapters: the nearest row of each other author, after the chapter's first hit."""
    hits = _ranked(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("chapter"), (F.col("vec_id") % 5).alias("author"), "rank")
    pool = _scored(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("chapter"), (F.col("vec_id") % 5).alias("author"), "score")
    return S.backfill(hits, pool).select(F.col("id").alias("vec_id"), F.col("chapter").alias("label"), "place")


@query("""with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rank, role from conversations),
x as (select *, first_value(role) over (partition by conv_id order by rank) as lead from t),
y as (select *, bool_or(role <> lead and rank <= 2) over (partition by conv_id) as mixed, min(case when role <> lead then rank end) over (partition by conv_id) as nxt from x)
select conv_id, turn from y where case when not mixed and nxt is not null then rank < 2 or rank = nxt else rank <= 2 end""")
def voices_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of each group, of two kinds where there are two."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(by).alias("rank"))
    return S.voices(t, 2, "role", ["conv_id"]).select("conv_id", "turn")


# The rule of turns as SQL: rounds within a tradition, one entry an author, then more of the same.
_DIVERSE = """k as (select *, case when tradition <> '' then tradition when year <= 500 then 'Early Church' when year <= 1500 then 'Medieval' when year <= 1700 then 'Reformation' when year is not null then 'Modern' else 'Unknown' end as kind,
 count(*) over (partition by g) as n from e),
a as (select *, row_number() over (partition by g, kind order by coalesce(year, 9999), position) as round, min(position) over (partition by g, kind) as turn from k),
b as (select *, row_number() over (partition by g, author order by round, turn) = 1 as first from a),
c as (select *, case when first then row_number() over (partition by g, first order by round, turn) end as pick from b),
d as (select *, coalesce(pick <= {most}, false) as taken from c),
f as (select *, sum(taken::int) over (partition by g) as picked, row_number() over (partition by g, taken order by turn, round) as more from d),
h as (select * from f where taken or more <= {most} - picked or n <= {most})
"""
_LINES = "e as (select l_orderkey as g, l_partkey::bigint * 1000000 + l_suppkey * 10 + l_linenumber as position, l_suppkey % 4 as author, case when l_partkey % 3 = 0 then l_returnflag else '' end as tradition, case when l_partkey % 7 <> 0 then (l_partkey * 37 % 1900)::int + 1 end as year from lineitem)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("g"), (F.col("l_partkey").cast("long") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("position"), (F.col("l_suppkey") % 4).alias("author"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).otherwise("").alias("tradition"),
        F.when(F.col("l_partkey") % 7 != 0, (F.col("l_partkey") * 37 % 1900).cast("int") + 1).alias("year"), (F.col("l_quantity") > 25).alias("on_verse"),
    )


@query(f"with {_LINES}, {_DIVERSE.format(most=3)} select g, position from h")
def diverse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries of each group, traditions in turn, authors once as long as there are others."""
    return S.diverse(_entries(spark, sf_dir), 3, ["g"]).select("g", "position")


@query(f"""with {_LINES.replace('e as (', 'e0 as (').replace(' from lineitem', ', l_quantity > 25 as on_verse from lineitem')},
c0 as (select *, (select count(distinct x.author) from e0 x where x.g = e0.g and x.on_verse) as exact, (select count(distinct x.author) from e0 x where x.g = e0.g) as every from e0),
e as (select g, position, author, tradition, year, case when exact >= 2 then 'verse' else 'chapter' end as rung from c0 where (exact >= 2 and on_verse) or (exact < 2 and every >= 2)),
{_DIVERSE.format(most=2)} select g, position, rung from h""")
def passage_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two voices on the verse if two authors have any, else on the chapter, else none."""
    return S.passage_voices(_entries(spark, sf_dir), ["g"]).select("g", "position", "rung")


@query("""with a as (select distinct o_custkey as q, o_orderkey % 400 as ch from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as q, o_orderkey % 400 as ch from orders where o_orderstatus = 'O')
select b.q as q, bool_or(a.ch is not null) as covered from b left join a on a.q = b.q and a.ch = b.ch group by 1""")
def passage_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was found shares a chapter with what was asked for."""
    o = table(spark, sf_dir, "orders")
    at = (F.col("o_orderkey") % 400) * 1000
    chunks = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("q"), (at + 3).alias("start"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(0)).otherwise(at + 9).alias("end"))
    asked = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("q"), (at + 500).alias("start"), (at + 999).alias("end"))
    return S.covers_passage(chunks, asked, ["q"])


_HISTORY = _S + """, d as (select doc_id as id, lang, n_chars, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t = 'the')) as tf, n_chars % 2000 as y1, case when doc_id % 2 = 0 then n_chars % 2000 + 100 end as y2 from documents),
le as (select id, null::double as text from d where lang = 'de' order by id limit 100), lp as (select id from d where y1 <= 700 and coalesce(y2, y1) >= 500 order by id limit 100),
lk as (select vec_id as id from s where vec_id in (select id from d) order by score desc, vec_id limit 50), lt as (select id, tf / (tf + 1) as text from d where tf > 0 order by text desc, id limit 50),
i as (select id from le union select id from lp union select id from lk union select id from lt),
f as (select i.id as id, i.id in (select id from le) as entity, case when i.id in (select id from le) or i.id in (select id from lp) or i.id in (select id from lk) then null else (select text from lt where lt.id = i.id) end as text from i),
r as (select f.id as id, entity, coalesce(y1 <= 700 and (y2 is null or y2 >= 500), false) as period, greatest(0, least(1, coalesce((select score from s where vec_id = f.id), 0))) as cosine, coalesce(text, 0) / coalesce(nullif((select max(text) from f), 0), 1) as text from f join d on d.id = f.id)
select id, round(3.0 * entity::int + 2.0 * period::int + cosine + 0.5 * least(1, text), 6) as score from r where entity or period or cosine >= 0.6 order by score desc, id limit 200"""


@query(_HISTORY)
def history_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four legs of candidates, of which the first that has a row counts; cosines looked up for all; entity 3, period 2, cosine 1, text 0.5."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text", (F.col("n_chars") % 2000).alias("y1"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") % 2000 + 100).alias("y2"))
    cosines = _scored(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("score").alias("cosine"))
    entity = docs.where("lang = 'de'").orderBy("id").limit(100).select("id")
    period = docs.where("y1 <= 700 and coalesce(y2, y1) >= 500").orderBy("id").limit(100).select("id")
    near = cosines.join(docs.select("id"), "id", "left_semi").orderBy(F.desc("cosine"), "id").limit(50).select("id")
    found = R.matches(docs.select("id", "text"), ["the"])
    text = found.select("id", R.frequency_rank(F.col("words"), ["the"]).alias("text")).orderBy(F.desc("text"), "id").limit(50)
    legs = S.folded([("entity", entity), ("period", period), ("near", near), ("text", text)], ["text"])
    rows = legs.join(docs.select("id", "y1", "y2"), "id").join(cosines, "id", "left")
    rows = rows.select("id", F.array_contains("legs", "entity").alias("entity"), S.overlaps_years(F.col("y1"), F.col("y2"), (500, 700)).alias("period"), "cosine", "text")
    return S.history_scored(rows).select("id", F.round("score", 6).alias("score"))


@query("""with c as (select dim, avg(x) as m from (select unnest(generate_series(0, len(embedding) - 1))::int as dim, unnest(embedding)::double as x from embeddings where label = 2) group by 1),
q as (select list(m order by dim) as qe from c), s as (select vec_id, label, vec_id % 7 as author, vec_id % 3 as work, list_cosine_similarity(embedding::double[], qe) as score from embeddings, q where label <> 2),
n as (select * from s qualify row_number() over (partition by label order by score desc, vec_id) <= 300),
b as (select * from n qualify row_number() over (partition by label, author, work order by score desc, vec_id) = 1)
select label, vec_id, round(score, 6) as score from b qualify row_number() over (partition by label order by b.score desc, vec_id) <= 6""")
def related_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is near the mean of a document's vectors, in every register: 300 candidates, one an author and work, six a register."""
    e = table(spark, sf_dir, "embeddings")
    mean = [r.mean for r in R.centroids(e.where("label = 2"), "label").orderBy("dim").collect()]
    s = e.where("label <> 2").select("vec_id", "label", (F.col("vec_id") % 7).alias("author"), (F.col("vec_id") % 3).alias("work"), R.cosine(F.col("embedding"), mean).alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    near = best_of(best_of(s, ["label"], order, 300), ["label", "author", "work"], order)
    return best_of(near, ["label"], order, 6).select("label", "vec_id", F.round("score", 6).alias("score"))


@query(_S + """, n as (select *, vec_id % 7 as author, vec_id % 3 as work from s where label in (1, 3) order by score desc, vec_id limit 500),
b as (select * from n qualify row_number() over (partition by author, work order by score desc, vec_id) = 1) select author, work, vec_id, round(score, 6) as score from b order by b.score desc, vec_id limit 8""")
def suggested_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest works of some kinds: the filter comes before the scan, one row an author and work, eight in all."""
    e = table(spark, sf_dir, "embeddings")
    near = R.nearest(e, _query(spark, sf_dir), 500, F.col("label").isin(1, 3)).select("vec_id", "score", (F.col("vec_id") % 7).alias("author"), (F.col("vec_id") % 3).alias("work"))
    best = best_of(near, ["author", "work"], [F.desc("score"), F.asc("vec_id")]).orderBy(F.desc("score"), "vec_id").limit(8)
    return best.select("author", "work", "vec_id", F.round("score", 6).alias("score"))


@query(_S + """, h as (select vec_id, score from s where label = 3 order by score desc, vec_id limit 3), a as (select l_suppkey as vec_id, min(l_partkey) as first, max(l_partkey) as last from lineitem where l_suppkey in (select vec_id from h) group by 1)
select vec_id, round(score, 6) as score, first, last from h left join a using (vec_id)""")
def user_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of one owner with the span of their anchors."""
    hits = R.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 3, F.col("label") == 3).select("vec_id", "score")
    anchors = table(spark, sf_dir, "lineitem").join(F.broadcast(hits.select(F.col("vec_id").alias("l_suppkey"))), "l_suppkey", "left_semi")
    spans = anchors.groupBy(F.col("l_suppkey").alias("vec_id")).agg(F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"))
    return hits.join(spans, "vec_id", "left").select("vec_id", F.round("score", 6).alias("score"), "first", "last")


@query("""with q as (select vec_id as qid, label as ql, embedding as qe from embeddings where vec_id % 100 = 0),
s as (select qid, ql, vec_id, label, vec_id % 5 as author, row_number() over (partition by qid order by list_cosine_similarity(embedding::double[], qe::double[]) desc, vec_id) as rank from embeddings, q where vec_id <> qid)
select qid, bool_or(rank = 1 and label = ql) as hit_1, count(distinct case when label = ql then author end) >= 2 as hit_2,
case when count(*) = 0 then 'no-content' when count(*) filter (where label = ql) = 0 then 'wrong-passage' when count(distinct case when label = ql then author end) < 2 then 'under-two-voices' else 'pass' end as code from s where rank <= 5 group by 1""")
def eval_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others: is the first of five on target, are two authors of five, and what is wrong if not."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    best = R.nearest_each(e, e.where("vec_id % 100 = 0"), 5)
    q = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    rows = best.join(e.select("vec_id", "label"), "vec_id").join(q, "qid")
    on = F.col("label") == F.col("ql")
    first, voices = F.max_by(on, F.struct("score", -F.col("vec_id"))), F.count_distinct(F.when(on, F.col("vec_id") % 5))
    code = F.when(F.count_if(on) == 0, "wrong-passage").when(voices < 2, "under-two-voices").otherwise("pass")
    return rows.groupBy("qid").agg(first.alias("hit_1"), (voices >= 2).alias("hit_2"), code.alias("code"))


_ALL = """with q as (select vec_id as qid, embedding as qe from embeddings where vec_id % 100 = 0),
s as (select qid, vec_id, label, list_cosine_similarity(embedding::double[], qe::double[]) as score from embeddings, q where vec_id <> qid)"""


@query("""with q as (select vec_id as qid, embedding as qe from embeddings where vec_id % 100 = 0),
s as (select qid, vec_id, list_cosine_similarity(embedding::double[], qe::double[]) as score from embeddings, q where vec_id <> qid)
select qid, vec_id, round(score, 6) as score from s qualify row_number() over (partition by qid order by s.score desc, vec_id) <= 10""")
def knn_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.nearest_each(e, e.where("vec_id % 100 = 0"), 10).select("qid", "vec_id", F.round("score", 6).alias("score"))


_ASKED = ("the", "license", "and")
_HYBRID_SQL = """
select qid, id, rank, round(text_score, 6) as text_score, round(vector_score, 6) as vector_score, round(score, 6) as score from hybrid_search(
  table(select qid, id, 'text' as list, score from asked join word_hits using (word) where qid < 400 and score > 0.5
        union all select qid, vec_id, 'vector', score from near where qid < 400)
  partition by qid, k => 10, text_weight => 0.4, vector_weight => 0.6)
"""


@query("""with q as (select vec_id as qid, embedding as qe, ['the', 'license', 'and'][(vec_id // 100 % 3 + 1)::int] as word from embeddings where vec_id % 100 = 0),
v as (select qid, vec_id as id, list_cosine_similarity(embedding::double[], qe::double[]) as score from embeddings, q where vec_id <> qid qualify row_number() over (partition by qid order by score desc, vec_id) <= 30),
w as (select doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as words from documents),
f as (select word, doc_id as id, len(list_filter(words, lambda t: t = word)) as tf from w, (values ('the'), ('license'), ('and')) x(word)),
h as (select word, id, tf / (tf + 1) as score from f where tf > 0 qualify row_number() over (partition by word order by tf / (tf + 1) desc, id) <= 50),
t as (select qid, id, score from q join h using (word) where score > 0.5), b as (select coalesce(t.qid, v.qid) as qid, coalesce(t.id, v.id) as id, t.score as text_score, v.score as vector_score from t full join v on t.qid = v.qid and t.id = v.id),
r as (select *, 0.4 * coalesce(text_score, 0) + 0.6 * coalesce(vector_score, 0) as score from b where qid < 400)
select qid, id, row_number() over (partition by qid order by round(score, 12) desc, id)::int as rank, round(text_score, 6) as text_score, round(vector_score, 6) as vector_score, round(score, 6) as score from r qualify rank <= 10""")
def hybrid_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search as a table function of SQL: candidates of each question from both lists, filtered before it and fused in it."""
    table_functions.register(spark)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0")
    R.nearest_each(e, q, 30).createOrReplaceTempView("near")
    word = F.element_at(F.array(*map(F.lit, _ASKED)), (F.floor(F.col("vec_id") / 100) % 3 + 1).cast("int"))
    q.select(F.col("vec_id").alias("qid"), word.alias("word")).createOrReplaceTempView("asked")
    found = P.search(documents_index(spark, sf_dir), spark, " OR ".join(_ASKED))
    each = found.rows.select("doc_id", F.inline(F.array(*[F.struct(F.lit(w).alias("word"), P.frequency_rank(found, [w]).alias("score")) for w in _ASKED]))).where("score > 0")
    best_of(each.select("word", F.col("doc_id").alias("id"), "score"), ["word"], [F.desc("score"), F.asc("id")], 50).createOrReplaceTempView("word_hits")
    return spark.sql(_HYBRID_SQL)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, V.Index]:
    """All vectors, and an index of them in the shared folder."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e, V.build(e, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", ("label",))


@query(_ALL + " select qid, vec_id, round(score, 6) as score from s qualify row_number() over (partition by qid order by s.score desc, vec_id) <= 10")
def knn_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector from the index, which stops where bounds prove that nothing nearer is left."""
    e, index = _index(spark, sf_dir)
    return V.search(index, e.where("vec_id % 100 = 0"), 10, exact=True).select("qid", "vec_id", F.round("score", 6).alias("score"))


@query(_ALL + " select qid, vec_id, round(score, 6) as score from s where label = 1 or vec_id between 100 and 130 qualify row_number() over (partition by qid order by s.score desc, vec_id) <= 10")
def knn_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the rows that a filter leaves."""
    e, index = _index(spark, sf_dir)
    found = V.search(index, e.where("vec_id % 100 = 0"), 10, (F.col("label") == 1) | F.col("vec_id").between(100, 130), exact=True)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"))


@query("with q as (select vec_id as qid from embeddings where vec_id % 100 = 0), n as (select count(*) as n from embeddings where label = 3) select qid, least(60, n.n - (select count(*) from embeddings where vec_id = qid and label = 3)) as n from q, n")
def knn_index_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 60 rows a filtered approximate search finds: all, as it probes more lists until it has them."""
    e, index = _index(spark, sf_dir)
    found = V.search(index, e.where("vec_id % 100 = 0"), 60, F.col("label") == 3, probes=2)
    return found.groupBy("qid").agg(F.count("*").alias("n"))


@query()
def knn_index_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten near vectors of every hundredth from the lists of the nearest centres; tests measure its recall."""
    e, index = _index(spark, sf_dir)
    return V.search(index, e.where("vec_id % 100 = 0"), 10).select("qid", "vec_id", F.round("score", 6).alias("score"))


@query("""with q as (select vec_id as qid, embedding as qe from embeddings where vec_id % 100 = 0) select qid, true as same from q""")
def index_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to the nearest rows of every hundredth vector, by blocks of all vectors or through the index: the same ids in the same order."""
    e, index = _index(spark, sf_dir)
    q = e.where("vec_id % 100 = 0")
    ids = lambda df: df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "vec_id"))).alias("l")).select("qid", F.col("l.vec_id").alias("ids"))
    by_blocks, by_index = ids(R.nearest_each(e.select("vec_id", "embedding"), q.select("vec_id", "embedding"), 5)), ids(V.search(index, q, 5, exact=True))
    return by_blocks.join(by_index.withColumnRenamed("ids", "others"), "qid", "full").select("qid", F.coalesce(F.col("ids") == F.col("others"), F.lit(False)).alias("same"))


@query("""with c as (select doc_id as id, substring(text, 1, 1200) as t from documents where lang = 'en' order by doc_id limit 30)
select id, length(regexp_replace(lower(t), '[^e]', '', 'g'))::double as score from c order by score desc, id limit 5""")
def rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short list in the order of a scorer that sees 1200 characters of each; here it counts a letter."""
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").orderBy("doc_id").limit(30).select(F.col("doc_id").alias("id"), "text")
    return S.reranked(rows, F.length(F.regexp_replace(F.lower("_scored"), "[^e]", "")).cast("double"), 5).select("id", "score")


@query("""select doc_id, case when strpos(lower(text), 'license') - 1 > 60 then substring(text, (least(strpos(lower(text), 'license') - 1 - 60, greatest(0, length(text) - 420)) + 1)::int, 420) else substring(text, 1, 420) end as excerpt,
true as verbatim from documents where contains(lower(text), 'license')""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of texts around a word; each must stand in its text as it is."""
    rows = table(spark, sf_dir, "documents").where(contains_literal(F.col("text"), "license"))
    return rows.select("doc_id", S.excerpt_around(F.col("text"), "license").alias("excerpt"), F.contains("text", S.excerpt_around(F.col("text"), "license")).alias("verbatim"))
