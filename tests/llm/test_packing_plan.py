"""The packing plan: what it holds, how near it is to the least number of sequences, and that the program's patterns make it."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm.packing import Config, best_fit, best_pattern, by_program, plan, sequences, slots


def held(packed) -> Counter:
    out: Counter = Counter()
    for copies, pattern in packed:
        for length, n in pattern:
            out[length] += copies * n
    return out


def made(seed: int, pieces: int, capacity: int) -> dict[int, int]:
    rng = np.random.default_rng(seed)
    sizes = np.minimum(capacity, 1 + rng.lognormal(np.log(capacity / 8), 1.0, pieces).astype(int))
    return {int(k): int(n) for k, n in zip(*np.unique(sizes, return_counts=True), strict=True)}


@pytest.mark.parametrize(("seed", "pieces"), [(1, 1), (2, 30), (3, 900), (4, 8000)])
def test_holds_each_piece_once_and_never_needs_more_than_best_fit(seed: int, pieces: int) -> None:
    config = Config(capacity=1024, rounds=150)
    h = made(seed, pieces, config.capacity)
    packed = plan(h, config)
    assert held(packed) == h and all(sum(x * n for x, n in p) <= config.capacity for _, p in packed)
    lengths, count = np.array(sorted(h)), np.array([h[k] for k in sorted(h)])
    bound = -(-sum(k * n for k, n in h.items()) // config.capacity)
    assert bound <= sequences(packed) <= sequences(best_fit(lengths, count, config.capacity))
    filled, left = by_program(lengths, count, config)
    assert held(filled) + Counter(dict(zip(lengths.tolist(), left.tolist(), strict=True))) == Counter(h)
    if pieces >= 900:
        # Nearly all sequences are patterns of the program, and hardly any more than the tokens need.
        assert sequences(filled) >= 0.95 * sequences(packed) and sequences(packed) <= bound * 1.005 + 1
    rows = slots(packed)
    assert sorted(rows.tolist()) == rows.tolist()


def test_knapsack_against_all_fillings() -> None:
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 20, 5))
        price, demand, capacity = rng.random(len(lengths)), rng.integers(0, 4, len(lengths)).astype(float), int(rng.integers(5, 40))
        worth = max(
            sum(n * p for n, p in zip(times, price, strict=True)) for times in itertools.product(*(range(int(d) + 1) for d in demand)) if sum(n * x for n, x in zip(times, lengths, strict=True)) <= capacity
        )
        pattern = best_pattern(lengths, price, demand, capacity, priced=99)
        assert sum(lengths[i] * n for i, n in pattern) <= capacity and all(n <= demand[i] for i, n in pattern)
        assert abs(sum(price[i] * n for i, n in pattern) - worth) < 1e-9


def test_least_number_of_sequences_of_small_cases() -> None:
    """Where best fit is not the best: two sequences of 5 + 3 + 2 and 4 + 4 + 2, and the like."""
    config = Config(capacity=10, rounds=50)
    assert plan({}, config) == []
    assert sequences(plan({10: 3}, config)) == 3
    assert sequences(plan({6: 2, 4: 2}, config)) == 2
    assert sequences(plan({5: 10, 3: 10, 2: 20, 4: 20}, config)) == (50 + 30 + 40 + 80) // 10
    # Largest first needs a further sequence here.
    assert sequences(best_fit(np.array([3, 4, 5, 6]), np.array([6, 3, 3, 3]), 12)) >= sequences(plan({6: 3, 5: 3, 4: 3, 3: 6}, Config(capacity=12, rounds=80))) == -(-(18 + 15 + 12 + 18) // 12)
