"""Limiters as parallel scans against their folds, event by event."""

from fractions import Fraction

import numpy as np
import pytest

from lexilake.streaming import folds as X
from lexilake.streaming import scans as Y

EVENTS = "user_id bigint, ms bigint, event_id bigint, lane string, other string"


def _events(spark, n=400, seed=1, span=4000):
    """One hot key, a few others and a null one; bursts, gaps and many equal times."""
    rng = np.random.default_rng(seed)
    ms = np.sort(np.concatenate([rng.integers(0, span, n // 2), rng.integers(span // 2, span // 2 + 50, n // 4), rng.integers(0, span // 40, n - n // 2 - n // 4) * 40]))
    rows = [([7, 7, 7, 7, 1, 2, 3, None][int(rng.integers(0, 8))], int(t), int(i), ["interactive", "background"][int(rng.integers(0, 3)) > 0], "x") for t, i in zip(ms, rng.permutation(n))]
    return spark.createDataFrame(rows, EVENTS), rows


def _fold(rows, step, *columns):
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        state[r[0]], out[r[2]] = step(state.get(r[0]), *(r[c] for c in columns))
    return out


@pytest.mark.parametrize("block,limit,window", [(5, 3, 45), (5, 2, 10_000), (37, 1, 1), (37, 10, 700), (10_000, 3, 45)])
def test_fixed_windows_are_the_fold(spark, block, limit, window):
    df, rows = _events(spark, seed=block)
    got = {r["event_id"]: (r["allowed"], r["retry_after_sec"]) for r in Y.fixed_window(df, "user_id", limit, window, block=block).collect()}
    assert got == _fold(rows, lambda s, ms: X.fixed_window(s, ms, limit, window), 1)


@pytest.mark.parametrize("block,capacity,rate", [(5, 2, 60), (5, 3, Fraction(7000)), (37, 1, 18), (37, 18, 18), (10_000, 2, Fraction(1, 3)), (11, 5, 30_000)])
def test_token_buckets_are_the_fold(spark, block, capacity, rate):
    df, rows = _events(spark, seed=block + 1)
    got = {r["event_id"]: (r["at"], pytest.approx(r["tokens"])) for r in Y.token_bucket(df, "user_id", capacity, rate, block=block).collect()}
    assert got == _fold(rows, lambda s, ms: X.token_bucket(s, ms, capacity, rate), 1)


@pytest.mark.parametrize("block,cap,reserve", [(5, 20, 6), (37, 20, 0), (10_000, 6, 6), (11, 5, 9), (23, 1000, 10)])
def test_budget_lanes_are_the_fold(spark, block, cap, reserve):
    df, rows = _events(spark, seed=block + 2)
    got = {r["event_id"]: (r["ok"], r["remaining"]) for r in Y.budget_lanes(df, "user_id", cap, reserve, block=block).collect()}
    assert got == _fold(rows, lambda s, ms, lane: X.budget_lane(s, ms, lane, cap, reserve), 1, 3)


def test_nothing_one_event_and_a_bucket_too_fast(spark):
    df, _ = _events(spark)
    for some, n in ((df.where("false"), 0), (df.where("event_id = 3"), 1)):
        assert Y.fixed_window(some, "user_id", 1, 10).count() == n
        assert Y.token_bucket(some, "user_id", 2, 60).count() == n
        assert Y.budget_lanes(some, "user_id", 5, 2).count() == n
    with pytest.raises(ValueError, match="folds.token_bucket"):
        Y.token_bucket(df, "user_id", 2, 120_000)


def test_functions_of_blocks_compose(spark):
    rng = np.random.default_rng(4)
    for _ in range(60):
        window = int(rng.integers(1, 40))
        ms = np.sort(rng.integers(0, 100, 40))
        cut = int(rng.integers(1, 39))
        one, two, both = Y.Windows.of(ms[:cut], 1, window), Y.Windows.of(ms[cut:], 1 + cut, window), Y.Windows.of(ms, 1, window)
        for end in range(-1, 130, 3):
            assert one.then(two)(end, -5) == both(end, -5) == two(*one(end, -5))


def test_a_hot_key_is_many_groups(spark):
    df, _ = _events(spark, n=600)
    hot = df.where("user_id = 7")
    rows = Y.blocked(hot, "user_id", block=20)
    assert rows.groupBy("block").count().agg({"count": "max"}).head()[0] < 0.3 * hot.count()
