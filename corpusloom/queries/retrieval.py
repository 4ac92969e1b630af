"""Vector search, fusion, selection and retrieval quality; labels of vectors stand for registers and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import postings as P
from corpusloom.operators import retrieval as R
from corpusloom.operators.relational import best_of
from corpusloom.queries.fulltext import documents_index
from corpusloom.queries.registry import query
from corpusloom.session import table

_S = "with q as (select embedding as qe from embeddings where vec_id = 7), s as (select vec_id, label, list_cosine_similarity(embedding::double[], qe::double[]) as score from embeddings, q)"


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """One row: the query vector."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


@query(_S + " select vec_id, round(score, 6) as score from s order by s.score desc, vec_id limit 20")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 20), "vec_id")


@query(_S + " select vec_id, round(score, 6) as score from s where vec_id between 100 and 300 or label = 1 order by s.score desc, vec_id limit 8")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.col("vec_id").between(100, 300) | (F.col("label") == 1)
    return _out(R.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 8, where), "vec_id")


@query(_S + " select label, vec_id, round(score, 6) as score from s qualify row_number() over (partition by label order by s.score desc, vec_id) <= 3")
def knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.nearest_per(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), "label", 3), "label", "vec_id")


@query("select label, dim, round(avg(x), 5) as mean from (select label, unnest(generate_series(0, len(embedding) - 1))::int as dim, unnest(embedding)::double as x from embeddings) group by 1, 2")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.centroids(table(spark, sf_dir, "embeddings"), "label").withColumn("mean", F.round("mean", 5))


@query(_S + """, p as (select vec_id, score, 0 as priority from s where label = 1 order by score desc, vec_id limit 2), f as (select vec_id, score, 1 as priority from s order by score desc, vec_id limit 10),
u as (select * from (select * from p union all select * from f) qualify row_number() over (partition by vec_id order by priority) = 1)
select vec_id, priority, round(score, 6) as score from u order by priority, u.score desc, vec_id limit 6""")
def lane_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a lane first, then the pool fills up, without repeats."""
    e, q = table(spark, sf_dir, "embeddings"), _query(spark, sf_dir)
    lane = R.nearest(e, q, 2, F.col("label") == 1).withColumn("priority", F.lit(0))
    both = lane.unionByName(R.nearest(e, q, 10).withColumn("priority", F.lit(1)))
    return _out(best_of(both, ["vec_id"], [F.asc("priority")]).orderBy("priority", F.desc("score"), "vec_id").limit(6), "vec_id", "priority")


_LISTS = _S + """, a as (select vec_id as id, row_number() over (order by score desc, vec_id) as rank, score from s order by score desc, vec_id limit 30),
w as (select doc_id as id, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t = 'the')) as tf from documents),
b as (select id, row_number() over (order by tf / (tf + 1) desc, id) as rank, tf / (tf + 1) as score from w where tf > 0 order by tf / (tf + 1) desc, id limit 30)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vector and text candidates, with ids of one space."""
    a = R.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 30).select(F.col("vec_id").alias("id"), "score")
    found = P.search(documents_index(spark, sf_dir), spark, "the")
    b = found.rows.select(F.col("doc_id").alias("id"), P.frequency_rank(found, ["the"]).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return R.ranked(a, "score", "id"), R.ranked(b, "score", "id")


@query(_LISTS + " select id, round(sum(1.0 / (60 + rank)), 8) as score from (select id, rank from a union all select id, rank from b) group by 1 order by sum(1.0 / (60 + rank)) desc, id limit 20")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.reciprocal_fusion([*_lists(spark, sf_dir)], "id")
    return fused.withColumn("score", F.round("score", 8)).orderBy(F.desc("score"), "id").limit(20)


@query(_LISTS + " select coalesce(a.id, b.id) as id, round(0.4 * coalesce(b.score, 0) + 0.6 * coalesce(a.score, 0), 6) as score from a full join b on a.id = b.id order by score desc, id limit 20")
def hybrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, text = _lists(spark, sf_dir)
    return R.linear_fusion(text, vector, "id").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20)


_RANKED = _S + ", r as (select vec_id, label, row_number() over (order by score desc, vec_id) as rank from s order by score desc, vec_id limit 40)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(R.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 40), "score", "vec_id").select("vec_id", "label", "rank")


@query(_RANKED + """, d as (select *, row_number() over (partition by label order by rank) > 2 and label <> 1 as deferred from r)
select vec_id, label, rank, deferred from d order by deferred, rank limit 12""")
def select_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select_diverse(_ranked(spark, sf_dir), "label", 12, 2, F.col("label") == 1)


@query(_RANKED + """, p as (select *, label = 2 and sum((label = 2)::int) over (order by rank) <= 2 as front from r) select vec_id, label, rank, row_number() over (order by front desc, rank) as place from p""")
def floor_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promoted(_ranked(spark, sf_dir), F.col("label") == 2)
