"""Hand-worked pages, claims and backfill ticks."""

from datetime import date

from lexilake.operators import decisions as D
from lexilake.operators import library as L

DAY = 86_400_000
IMPORTS = "import_id bigint, state string, n_candidates bigint, next_index bigint, released_on date, released_for_day bigint"


def test_pages_walk_all_items_once(spark):
    items = spark.createDataFrame([(k, 100 + k // 2) for k in range(7)], "item_id bigint, created_at bigint")
    seen, cursor = [], None
    for want in ((3, True), (3, True), (1, False)):
        page = L.built_page(items, "newest", 3, cursor).collect()
        assert (len(page), page[0]["has_more"]) == want
        seen += [r["item_id"] for r in page]
        cursor = (page[-1]["next_value"], page[-1]["next_id"])
    assert seen == [6, 5, 4, 3, 2, 1, 0] and cursor == (None, None)
    assert L.built_page(items.where("false"), "newest", 3).collect() == []


def test_the_oldest_due_job_is_claimed(spark):
    jobs = spark.createDataFrame([(1, "queued", 30, 0), (2, "queued", 10, 2), (3, "active", 5, 1), (4, "queued", 10, 0), (5, "queued", None, 0)], "job_id int, status string, run_at bigint, attempts int")
    assert [tuple(r) for r in D.claimed(jobs, 20).collect()] == [(2, "active", 10, 3)]
    assert [r["job_id"] for r in D.claimed(jobs, 20, 9).collect()] == [2, 4]
    assert D.claimed(jobs, 9).collect() == []


def test_a_tick_takes_the_least_of_its_limits(spark):
    today, before = date(1970, 1, 4), date(1970, 1, 3)
    rows = [
        (1, "running", 100, 10, before, 50),  # a new day: the tick's own limit
        (2, "running", 100, 95, today, 3),  # what is left ends it
        (3, "running", 100, 10, today, 48),  # the daily cap leaves two
        (4, "running", 100, 10, today, 50),
        (5, "running", 100, 100, today, 1),
        (6, "paused", 100, 10, None, 0),
    ]
    imports = spark.createDataFrame(rows, IMPORTS)
    got = {r[0]: tuple(r)[1:] for r in D.backfill_tick(imports, 3 * DAY + 5, 50, 30, 999).collect()}
    assert got == {
        1: ("progressed", 20, None, "running", 30, today, 20),
        2: ("completed", 5, None, "completed", 100, today, 8),
        3: ("progressed", 2, None, "running", 12, today, 50),
        4: ("daily_cap_reached", 0, 4 * DAY, "running", 10, today, 50),
        5: ("completed", 0, None, "completed", 100, today, 1),
        6: ("not_running", 0, None, "paused", 10, None, 0),
    }
    got = {r[0]: tuple(r)[1:4] for r in D.backfill_tick(imports, 3 * DAY + 5, 50, 0, 999).collect()}
    assert got[1] == ("waiting_for_budget", 0, 999) and got[4][0] == "daily_cap_reached"
