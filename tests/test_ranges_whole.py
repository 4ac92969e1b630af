"""Interval queries over every order, compared with brute force."""

from __future__ import annotations

from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from oracle import comparable, spark_rows
from pyspark.sql import SparkSession

from corpusloom import catalog

SF = "/root/testdata/sf0.001"


def expected() -> dict[str, tuple[list[str], list[tuple]]]:
    orders, points = ([tuple(r.values()) for r in pq.read_table(f"{SF}/{t}.parquet", columns=c).to_pylist()] for t, c in (("orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), ("part", ["p_partkey", "p_brand"])))
    spans = [(k, c, s, c, c + k % 40) for k, c, s in orders]
    hits = {(p, b): [x for x in spans if x[3] <= p <= x[4]] for p, b in points}
    brands = defaultdict(list)
    for (p, b), found in hits.items():
        brands[b].append((p, found))
    sources = {p: (len({x[1] for x in f}), len({x[1] for x in f if x[2] != "F"}), len({x[0] for x in f})) for (p, _), f in hits.items()}
    floors: dict[int, int] = defaultdict(int)
    for before, _, _ in sources.values():
        floors[min(before, 3)] += 1
    covered = {b: sum(bool(f) for _, f in own) for b, own in brands.items()}
    first = {b: min(x[0] for _, f in own for x in f) for b, own in brands.items() if covered[b]}
    ranked = [(b, len({x[0] for _, f in own for x in f if x[2] == "O"}), sum(x[2] == "O" for _, f in own for x in f)) for b, own in brands.items()]
    rows = {
        "range_join_hits": (["p_partkey", "o_orderkey"], [(p, x[0]) for (p, _), f in hits.items() for x in f]),
        "coverage_sweep": (["p_partkey", "n_sources", "n_units"], [(p, n, u) for p, (n, _, u) in sources.items() if u]),
        "voice_floor_hist": (["n_sources", "n_points"], [*floors.items()]),
        "coverage_census": (["p_brand", "n_points", "n_covered", "share"], [(b, len(own), covered[b], covered[b] / len(own)) for b, own in brands.items()]),
        "coverage_diff": (["p_partkey", "before", "after", "class"], [(p, n, m, "floor_broken" if m < 2 <= n else "fewer") for p, (n, m, _) in sources.items() if m < n]),
        "grounding_anti": (["p_partkey"], [(p,) for (p, _), f in hits.items() if not f]),
        "first_match_ordinal": (["p_brand", "first_unit"], [*first.items()]),
        "tradition_gap": (["p_brand", "n_ranges", "n_hits"], sorted((r for r in ranked if r[2]), key=lambda r: (-r[1], r[0]))[:10]),
    }
    return {name: comparable(*r) for name, r in rows.items()}


@pytest.fixture(scope="module")
def brute_force() -> dict[str, tuple[list[str], list[tuple]]]:
    return expected()


@pytest.mark.parametrize("name", ["range_join_hits", "coverage_sweep", "voice_floor_hist", "coverage_census", "coverage_diff", "grounding_anti", "first_match_ordinal", "tradition_gap"])
def test_every_order(spark: SparkSession, brute_force: dict, name: str) -> None:
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == brute_force[name]
