"""Coverage of points by intervals, counted by sweeping over boundaries: no pair of a point and an interval is ever made.

An interval is +1 where it begins and -1 behind its end. Summed by place for each
source, running sums tell where a source begins to cover and where it stops, however its
intervals overlap. These places, +1 and -1 again, summed over all sources,
have a running sum that is the number of different sources at each place.

Running sums are taken by buckets of places: each bucket's total, the totals before
it as what it starts from, and a running sum within it. So a source with a large share of
all intervals, or the one sweep over all sources, is spread over as many tasks as there are buckets.
Deltas are summed by place before they are sorted, so a crowded place is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running(deltas: DataFrame, keys: list[str], place: str, delta: str, low: int, width: int) -> DataFrame:
    """deltas, one row for each (keys, place), with column running: the sum of delta up to each place, its own included.

    The totals of the buckets are sorted by themselves: for all of a key there are no more of them than buckets.
    """
    own = deltas.withColumn("_bucket", F.floor((F.col(place) - F.lit(low)) / width).cast("long"))
    totals = own.groupBy(*keys, "_bucket").agg(F.sum(delta).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_carried"))
    within = F.sum(delta).over(Window.partitionBy(*keys, "_bucket").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_within", within).join(carried, [*keys, "_bucket"]).withColumn("running", F.col("_within") + F.col("_carried")).drop("_bucket", "_within", "_carried")


def boundaries(intervals: DataFrame, start: Column, end: Column, source: Column | None) -> DataFrame:
    """([_source,] _place, _delta) of intervals whose end is not before their start, summed by place; zero sums stay out."""
    keys = [] if source is None else ["_source"]
    own = intervals.where(start <= end).select(*([] if source is None else [source.alias("_source")]), F.inline(F.array(F.struct(start.cast("long").alias("_place"), F.lit(1).alias("_delta")), F.struct((end + 1).cast("long").alias("_place"), F.lit(-1).alias("_delta")))))
    return own.groupBy(*keys, "_place").agg(F.sum("_delta").alias("_delta")).where("_delta <> 0")


def _spread(intervals: DataFrame, start: str, end: str, buckets: int) -> tuple[int, int]:
    """The lowest place and the width of a bucket."""
    r = intervals.where(F.col(start) <= F.col(end)).agg(F.min(start).alias("low"), F.max(end).alias("high")).first()
    low, high = (0, 0) if r.low is None else (int(r.low), int(r.high))
    return low, max(1, -(-(high + 2 - low) // buckets))


def covered(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, source: str | None = None, n: str = "n", buckets: int = BUCKETS) -> DataFrame:
    """points with column n: by how many different sources (or, without source, intervals) each is covered, ends included.

    A null source counts as one more source. Points that are null or that nothing covers have 0; points
    that repeat each have their row. Intervals with a null end, or an end before their start, cover nothing.
    """
    low, width = _spread(intervals, start, end, buckets)
    if source is None:
        steps = boundaries(intervals, F.col(start), F.col(end), None)
    else:
        # A null key must meet itself in the join of running(), so sources are compared as (is null, value).
        key = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
        own = running(boundaries(intervals, F.col(start), F.col(end), key), ["_source"], "_place", "_delta", low, width)
        # Where a source begins to cover, and where it stops.
        turn = F.when((F.col("running") > 0) & (F.col("running") == F.col("_delta")), 1).when((F.col("running") == 0), -1)
        steps = own.select("_place", turn.alias("_delta")).where("_delta is not null").groupBy("_place").agg(F.sum("_delta").alias("_delta"))
    asked = points.select(F.col(point).cast("long").alias("_place")).where("_place is not null").distinct()
    both = steps.select("_place", "_delta", F.lit(False).alias("_asked")).unionByName(asked.select("_place", F.lit(0).cast("long").alias("_delta"), F.lit(True).alias("_asked")))
    places = both.groupBy("_place").agg(F.sum("_delta").alias("_delta"), F.bool_or("_asked").alias("_asked"))
    # Places outside the intervals' reach fall into the first and last bucket or just beyond; all are before or behind everything.
    reach = places.withColumn("_at", F.greatest(F.lit(low - 1), F.least(F.col("_place"), F.lit(low + width * buckets + 1))))
    merged = reach.groupBy("_at").agg(F.sum("_delta").alias("_delta"))
    sums = running(merged, [], "_at", "_delta", low - 1, width).select("_at", F.col("running").alias("_n"))
    found = reach.where("_asked").join(sums, "_at").select("_place", "_n")
    return points.join(found, F.col(point).cast("long") == F.col("_place"), "left").withColumn(n, F.coalesce("_n", F.lit(0)).cast("long")).drop("_place", "_n")
