"""Edit-distance joins, edition masks, digests of changing tables and vector sums against plain versions."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import digests, editions, edits, retrieval


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_words(spark: SparkSession) -> None:
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    words = [word(rng.randint(0, 9)) for _ in range(150)] + [word(30) for _ in range(10)]
    # Long words that differ before, at and behind the part that is filed.
    for w in words[-10:]:
        for at in (0, 5, 10, 11, 12, 13, 20, 29):
            words += [w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "xx" + w[at + 2 :], w[: max(0, at - 2)] + w[at:], w[:at] + "xyz" + w[at:]]
    left = [(w, rng.randint(0, 2)) for w in words] + [(None, 1), ("aaa", None), ("ab", 0), ("ab", 2)]
    right = [*words[::2], "ab", "ba", "abab", None, ""]
    got = {(r.w, r.v): r.distance for r in edits.near(spark.createDataFrame(left, "w string, k int"), spark.createDataFrame([(v,) for v in right], "v string"), "w", "v", "k").collect()}
    most: dict[str, int] = {}
    for w, k in left:
        if w is not None and k is not None:
            most[w] = max(most.get(w, 0), k)
    want = {(w, v): d for w, k in most.items() for v in set(right) - {None} if abs(len(w) - len(v)) <= k and (d := distance(w, v)) <= k}
    assert got == want and any(d == 2 and len(w) > 20 for (w, _), d in want.items())


def test_a_word_of_any_length_has_few_entries(spark: SparkSession) -> None:
    n = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz" * 1000,), ("",)], "w string").select(F.size(edits.entries(F.col("w"), F.lit(2))).alias("n")).collect()
    assert [r.n for r in n] == [79, 1]


def made(seed: int) -> list[tuple[str, int, int | None]]:
    rng = random.Random(seed)
    rows = []
    for e in ["b", "a", "d", "c", "z"]:
        for p in range(12):
            if rng.random() < 0.8:
                # Some passages are too short for a shingle; rows repeat.
                rows += [(e, p, None)] if rng.random() < 0.2 else [(e, p, rng.randint(0, 6 if e < "c" else 40)) for _ in range(rng.randint(1, 8))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_likeness_and_families(spark: SparkSession, seed: int) -> None:
    rows = made(seed)
    df = spark.createDataFrame(rows, "edition string, passage int, shingle int").repartition(3)
    sets: dict[tuple[str, int], set[int]] = {}
    for e, p, s in rows:
        sets.setdefault((e, p), set()).update([] if s is None else [s])
    names = sorted({e for e, _ in sets})
    want = {}
    for a, b in itertools.combinations(names, 2):
        alike = [len(sets[a, p] & sets[b, p]) / len(sets[a, p] | sets[b, p]) for p in range(12) if (a, p) in sets and (b, p) in sets and sets[a, p] | sets[b, p]]
        if alike:
            want[a, b] = (len(alike), round(sum(alike) / len(alike), 9))
    assert {(r.edition, r.other): (r.n_passages, round(r.likeness, 9)) for r in editions.likeness(df).collect()} == want
    threshold, family = 0.2, {n: n for n in names}
    for _ in names:
        for (a, b), (_, x) in want.items():
            if x >= threshold:
                family[a] = family[b] = min(family[a], family[b])
    all_of = lambda members: set().union(*(s for (e, _), s in sets.items() if e in members))
    plain = {n: (family[n], len(all_of({x for x in names if family[x] == family[n]})), max(len(all_of({x})) for x in names if family[x] == family[n])) for n in names}
    assert {r.edition: (r.family, r.united, r.largest) for r in editions.families(df, threshold).collect()} == plain
    assert editions.families(df.limit(0), threshold).collect() == [] and editions.likeness(df.where("edition = 'a'")).collect() == []


def test_digest_follows_changes(spark: SparkSession) -> None:
    df = lambda rows: spark.createDataFrame(rows, "part string, line string")
    old = [("a", "x"), ("a", "x"), ("a", None), ("b", ""), (None, "y"), *(("c", f"row {i}") for i in range(2000))]
    new, gone = [("a", "z"), ("d", "x"), ("b", None)], [("a", "x"), ("b", ""), ("c", "row 7"), (None, "y")]
    after = list(old)
    for r in gone:
        after.remove(r)
    of = lambda rows: digests.of_rows(df(rows), F.col("line"), "part")
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    updated = digests.changed(of(old), of(new), of(gone), "part")
    assert rows(updated) == rows(of(after + new)) and not any(r.part is None for r in updated.collect())
    assert rows(digests.whole(updated)) == rows(digests.whole(digests.of_rows(df(after + new).repartition(7).orderBy(F.desc("line")), F.col("line"), "part")))
    different = {digests.whole(of(x)).first().digest for x in (old, old + [("a", "x")], old[1:], [("a", ""), *old[1:]], [("b", "x"), *old[1:]])}
    assert len(different) == 4  # rows say nothing of their part
    assert digests.whole(of([]).limit(0)).first().n == 0


def test_mean_vectors(spark: SparkSession) -> None:
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 5.0]), ("a", None), ("a", [9.0]), (None, [4.0, 4.0]), ("b", []), ("c", [1.0, 1.0]), ("c", [2.0])]
    df = spark.createDataFrame(rows, "label string, embedding array<float>").repartition(4)
    means = retrieval.centroids(df, "label", spread=2)
    assert sorted((tuple(r) for r in means.collect()), key=repr) == [("a", 0, 2.0), ("a", 1, 3.5), ("c", 0, 2.0), (None, 0, 4.0), (None, 1, 4.0)]
    assert "Generate" not in means._jdf.queryExecution().executedPlan().toString()
    assert retrieval.centroids(df.limit(0), "label").collect() == []
