"""Table functions for SQL: hybrid search over candidate lists.

    SELECT * FROM hybrid_search(
        TABLE(SELECT qid, id, 'text' AS list, score FROM ... UNION ALL SELECT qid, id, 'vector', score FROM ...)
        PARTITION BY qid, k => 10, text_weight => 0.4, vector_weight => 0.6)

The lists are made and filtered by the query inside TABLE(...), where Spark pushes filters
to the scans; PARTITION BY qid, which a call must say, brings each question's candidates together. It adds up an
id's weighted scores, 0 where a list lacks it, and gives the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

COLUMNS = ("qid", "id", "list", "score")


class HybridSearch:
    """k, text_weight and vector_weight are constants of the call. Rows with a null id or score are left out; of an id that repeats in a list the highest score counts; ties go to the smaller id."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument, text_weight: AnalyzeArgument, vector_weight: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or any(c not in rows.dataType.names for c in COLUMNS):
            raise ValueError(f"hybrid_search needs a table with the columns {', '.join(COLUMNS)}")
        for name, a in (("k", k), ("text_weight", text_weight), ("vector_weight", vector_weight)):
            if a.value is None:
                raise ValueError(f"{name} must be a constant")
        if int(k.value) < 1:
            raise ValueError("k must be 1 or more")
        schema = StructType().add("qid", rows.dataType["qid"].dataType).add("id", LongType()).add("rank", IntegerType()).add("text_score", DoubleType()).add("vector_score", DoubleType()).add("score", DoubleType())
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.scores: dict[int, list[float | None]] = {}
        self.call: tuple[int, float, float] = (0, 0.0, 0.0)
        self.qid: object = None
        self.begun = False

    def eval(self, row: Row, k: int, text_weight: float, vector_weight: float) -> None:
        if self.begun and row["qid"] != self.qid:
            raise ValueError("hybrid_search must be called with PARTITION BY qid")
        self.begun = True
        self.call, self.qid = (int(k), float(text_weight), float(vector_weight)), row["qid"]
        if row["id"] is None or row["score"] is None:
            return
        own = self.scores.setdefault(row["id"], [None, None])
        at = 0 if row["list"] == "text" else 1
        if own[at] is None or row["score"] > own[at]:
            own[at] = float(row["score"])

    def terminate(self) -> Iterator[tuple]:
        k, *weights = self.call
        total = {i: sum(w * (s or 0.0) for w, s in zip(weights, both, strict=True)) for i, both in self.scores.items()}
        for rank, i in enumerate(sorted(total, key=lambda i: (-round(total[i], 12), i))[:k], 1):
            yield self.qid, i, rank, *self.scores[i], total[i]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("hybrid_search", udtf(HybridSearch))
