from pyspark.sql import functions as F

from lexilake.sources import tables as D
from lexilake.streaming import folds as X
from lexilake.streaming import sources as Z


def test_fixed_window_by_hand():
    state, out = None, []
    for ms in (0, 10, 20, 999, 1000, 1001):
        state, said = X.fixed_window(state, ms, 2, 1000)
        out.append(said)
    assert out == [(True, 0), (True, 0), (False, 1), (False, 1), (True, 0), (True, 0)]


def test_token_bucket_by_hand():
    state, out = None, []
    for ms in (0, 0, 0, 30_000, 60_000):
        state, said = X.token_bucket(state, ms, 2, 1)
        out.append(said[0])
    assert out == [0, 0, 60_000, 120_000, 180_000]  # none is refused: each waits for its turn and a token


def test_budget_lanes_by_hand():
    state, out = None, []
    for lane in ("background", "background", "interactive", "background", "interactive", "interactive"):
        state, said = X.budget_lane(state, 5, lane, 4, 2)
        out.append(said[0])
    assert out == [True, True, True, False, True, False]
    assert X.budget_lane(state, 86_400_000, "background", 4, 2)[1] == (True, 1)


def test_jobs_fail_after_their_attempts():
    state = None
    state, _ = X.job_state(state, 0, "enqueue")
    now = 0
    for attempt in range(1, 6):
        now = state[2]
        state, said = X.job_state(state, now, "claim")
        assert said[:2] == ("active", attempt)
        state, said = X.job_state(state, now, "fail")
    assert said[0] == "failed"


def test_stream_equals_batch(spark, sf, tmp_path):
    events = D.events(spark, sf).select("event_id", "user_id", "ms")
    step = lambda s, ms: X.fixed_window(s, ms, 2, 86_400_000)
    batch = X.folded(events, "user_id", ["ms"], step, "allowed boolean, retry_after_sec bigint")
    stream = X.folded_stream(Z.event_stream(spark, sf).select("event_id", "user_id", "ms"), "user_id", ["ms"], step, "allowed boolean, retry_after_sec bigint", "count bigint, until bigint")
    stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("event_id", "allowed", "retry_after_sec").collect()))
    assert key(spark.table("limited")) == key(batch)


def test_daily_counts_stream_equals_batch(spark, sf, tmp_path):
    kept = []
    Z.run_once(X.daily_counts(Z.event_stream(spark, sf)), lambda df, _: kept.append({(r["day_ms"], r["event_type"]): r["n"] for r in df.collect()}), str(tmp_path), "complete")
    day = (F.floor(F.col("ms") / 86_400_000) * 86_400_000).alias("day")
    want = {(r["day"], r["event_type"]): r["n"] for r in D.events(spark, sf).groupBy(day, "event_type").agg(F.count("*").alias("n")).collect()}
    assert kept[-1] == want


def test_spacing_is_the_fold(spark):
    rows = [(1, k, ms) for k, ms in enumerate((0, 10, 400, 401, 2000))]
    out = X.spaced(spark.createDataFrame(rows, "user_id int, event_id int, ms bigint"), "user_id", 250).orderBy("event_id").collect()
    assert [r["start"] for r in out] == [0, 250, 500, 750, 2000]
