"""Import progress: states by actions, ticks within one shared budget, a stream that is run again."""

from datetime import date

import pytest

from lexilake.streaming import imports as I
from lexilake.streaming.sources import run_once

DAY = 86_400_000
EVENTS = "ms bigint, import_id bigint, action string, external bigint, resets_at bigint"


def test_actions_lead_between_the_five_states(spark):
    rows = [(k, s, 9, 0, None, 0, None) for k, s in enumerate(("previewed", "running", "paused", "completed", "failed"))]
    imports = spark.createDataFrame(rows, I.PROGRESS)
    want = {"commit": ["running", *["conflict"] * 4], "pause": ["conflict", "paused", *["conflict"] * 3], "resume": ["conflict", "conflict", "running", "conflict", "conflict"], "cancel": ["failed", "failed", "failed", "conflict", "conflict"]}
    for action, outcomes in want.items():
        asked = spark.createDataFrame([(k, action) for k in (*range(5), 77)], "import_id bigint, action string")
        assert [r["outcome"] for r in I.acted(imports, asked).orderBy("import_id").collect()] == [*outcomes, "not found"]
        after = {r["import_id"]: (r["state"], r["error"]) for r in I.after_actions(imports, asked).collect()}
        assert after == {k: (rows[k][1] if o == "conflict" else o, I.CANCELLED if action == "cancel" and o == "failed" else None) for k, o in enumerate(outcomes)}


@pytest.mark.parametrize("external,block", [(0, 3), (7, 3), (33, 100), (1000, 2)])
def test_a_tick_never_releases_more_than_the_shared_budget(spark, external, block):
    today = date(1970, 1, 2)
    rows = [(k, ["running", "paused"][k % 5 == 4], 30, k, today if k % 2 else None, k % 12, None) for k in range(25)]
    got = {r["import_id"]: r for r in I.shared_tick(spark.createDataFrame(rows, I.PROGRESS), DAY + 9, 10, external, 5, 8, block).collect()}
    left = external
    for k, state, n, at, on, used, _ in rows:
        n_out = 0 if state == "paused" else max(0, min(n - at, 10 - (used if on else 0), 8, left))
        left -= n_out
        assert (got[k]["enqueued"], got[k]["next_index"]) == (n_out, at + n_out)
    assert sum(r["enqueued"] for r in got.values()) <= external


def test_ticks_of_a_stream(spark, tmp_path):
    path, src, state = (str(tmp_path / d) for d in ("imports", "src", "state"))
    I.start(spark.createDataFrame([(1, 5), (2, 30), (3, 4)], "import_id bigint, n_candidates bigint"), path)
    links = spark.createDataFrame([(i, k, f"u{i}-{k}") for i, n in ((1, 5), (2, 30), (3, 4)) for k in range(n)], "import_id bigint, idx bigint, url string")
    each, cut = I.ticking(path, links, daily=12, per_tick=6), [True]

    def sink(batch, number):
        each(batch, number)
        if cut[0] and number == 1:
            cut[0] = False
            raise RuntimeError("killed")  # after all was written: the batch comes again

    def seen():
        return {r["import_id"]: (r["state"], r["next_index"]) for r in I.progress(spark, path).collect()}

    batches = [
        ([(0, 1, "commit", None, None), (0, 2, "commit", None, None), (5, None, None, 100, DAY)], {1: ("completed", 5), 2: ("running", 6), 3: ("previewed", 0)}),
        ([(9, None, None, 4, DAY)], {1: ("completed", 5), 2: ("running", 10), 3: ("previewed", 0)}),  # the shared budget
        ([(10, 3, "commit", None, None), (11, None, None, 100, DAY)], {1: ("completed", 5), 2: ("running", 12), 3: ("completed", 4)}),  # its own day
        ([(12, 2, "pause", None, None), (DAY, None, None, 100, 2 * DAY)], {1: ("completed", 5), 2: ("paused", 12), 3: ("completed", 4)}),
        ([(DAY + 1, 2, "resume", None, None), (DAY + 1, None, None, 100, 2 * DAY)], {1: ("completed", 5), 2: ("running", 18), 3: ("completed", 4)}),
        ([(DAY + 2, 2, "cancel", None, None)], {1: ("completed", 5), 2: ("failed", 18), 3: ("completed", 4)}),
    ]
    for k, (rows, want) in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{src}/{k}")
        stream = spark.readStream.schema(EVENTS).parquet(f"{src}/*")
        try:
            run_once(stream, sink, state)
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
            run_once(stream, sink, state)
        assert seen() == want
    out = sorted((r["import_id"], r["idx"], r["url"]) for r in I.released(spark, path).collect())
    assert out == [(i, k, f"u{i}-{k}") for i, n in ((1, 5), (2, 18), (3, 4)) for k in range(n)]  # each once
