"""The stage pipeline by hand, as a stream against the batch, and across a query that is cut off."""

import json

import pytest
from pyspark.sql import functions as F

from lexilake.streaming import stages as P
from lexilake.streaming.sources import run_once

REQUESTS = "item_id bigint, ms bigint, stage string, payload string"


def _fails(name):
    """A stage that fails as the payload says: so many times, or for good ("never")."""

    def run(key, payload, attempt):
        said = json.loads(payload or "{}").get(name, 0)
        if said == "never":
            raise P.PermanentError(f"{name} cannot")
        if attempt <= said:
            raise RuntimeError(f"{name} {attempt}")

    return name, run


STAGES = P.Stages([_fails("extract"), _fails("enrich"), _fails("index")])
ROWS = [
    (1, 0, None, "{}"),
    (2, 10, None, '{"enrich": 2}'),
    (3, 20, None, '{"extract": "never"}'),
    (4, 30, None, '{"index": 9}'),
    (5, 40, "index", None),
    (5, 45, "nowhere", None),
    (2, 2000, None, None),  # it waits: a conflict
    (3, 9000, "enrich", "{}"),  # a retry from a later stage
    (None, 50, None, None),
]


def _said(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0], r[3], r[1] or "", r[2] or 0))


def test_by_hand(spark):
    got = _said(P.batch(spark.createDataFrame(ROWS, REQUESTS), STAGES))
    of = lambda i: [r[1:6] for r in got if r[0] == i]
    assert of(1) == [("enrich", 1, 0, "done", "processing"), ("extract", 1, 0, "done", "processing"), ("index", 1, 0, "done", "done")]
    assert of(2) == [
        ("enrich", 1, 10, "retry", "processing"), ("extract", 1, 10, "done", "processing"), ("enrich", 2, 1010, "retry", "processing"),
        (None, None, 2000, "conflict", "processing"), ("enrich", 3, 3010, "done", "processing"), ("index", 1, 3010, "done", "done"),
    ]
    assert of(3) == [("extract", 1, 20, "failed", "failed"), ("enrich", 1, 9000, "done", "processing"), ("index", 1, 9000, "done", "done")]
    assert [r[2:5] for r in got if r[0] == 4 and r[1] == "index"] == [(1, 30, "retry"), (2, 1030, "retry"), (3, 3030, "retry"), (4, 7030, "retry"), (5, 15030, "failed")]
    assert [r[6] for r in got if r[0] == 4][-1] == "index 5 (gave up after 5 attempts)"
    assert of(5) == [("index", 1, 40, "done", "done"), ("nowhere", None, 45, "unknown stage", "done")]
    assert not [r for r in got if r[0] is None]
    assert P.batch(spark.createDataFrame([], REQUESTS), STAGES).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(ValueError, match="providerClass"):
        P.stream(spark.readStream.format("rate").load().selectExpr("value as item_id", "value as ms", "'' as stage", "'' as payload"), STAGES)
    spark.conf.set(name, P.ROCKSDB)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("killed", [False, True])
def test_stream_equals_batch_and_a_killed_query_goes_on(spark, tmp_path, rocks, killed):
    rows = [(i, ms + 10**6, stage, payload) for i, ms, stage, payload in ROWS if i is not None]  # a watermark begins at 0
    late = [(99, 10**6 + 60_000, None, "{}")]  # moves the watermark past every wait
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    cut = [killed]

    def sink(batch, number):
        if cut[0] and number == 1:
            batch.collect()  # the stages ran, nothing was kept
            cut[0] = False
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = lambda: P.stream(spark.readStream.schema(REQUESTS).parquet(f"{src}/*"), STAGES, "1 second")
    for k, some in enumerate((rows[:4], rows[4:7], rows[7:], late)):
        spark.createDataFrame(some, REQUESTS).coalesce(1).write.parquet(f"{src}/{k}")
        try:
            run_once(stream(), sink, state)
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
            run_once(stream(), sink, state)
    assert cut == [False]
    got = _said(spark.read.parquet(out).drop("batch"))
    want = _said(P.batch(spark.createDataFrame(rows + late, REQUESTS), STAGES, until_ms=10**6 + 59_000))
    assert got == want and len(got) == len(set(got))
