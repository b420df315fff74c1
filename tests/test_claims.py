"""Claims: several writers never hold a job at once, leases run out, the log can be compacted."""

import subprocess
import sys
import threading
import time

from lexilake.operators.claims import ClaimLog


def _jobs(spark, n):
    return spark.createDataFrame([(k, 100 + k % 5) for k in range(n)], "job_id bigint, run_at bigint")


def _ids(df):
    return sorted(r["job_id"] for r in df.collect())


def test_a_job_by_hand(spark, tmp_path):
    log = ClaimLog(spark, str(tmp_path))
    assert log.state()[0].count() == 0 and log.claim("a", 0).count() == 0
    assert _ids(log.enqueue(spark.createDataFrame([(1, 50), (2, 40), (2, 45), (3, 900), (None, 1)], "job_id bigint, run_at bigint"))) == [1, 2, 3]
    assert log.enqueue(spark.createDataFrame([(1, 0)], "job_id bigint, run_at bigint")).count() == 0
    assert _ids(log.claim("a", 100, most=1, lease_ms=10)) == [2]  # the oldest due
    assert _ids(log.claim("b", 100, most=5, lease_ms=10)) == [1]
    assert _ids(log.claim("b", 109, most=5)) == []
    assert _ids(log.claim("b", 110, most=1, lease_ms=1000)) == [2]  # a's lease ran out
    assert _ids(log.complete("a", [2], 111)) == []
    assert _ids(log.complete("b", [2, 1], 111)) == [2]
    got = {r["job_id"]: (r["status"], r["attempts"], r["run_at"]) for r in log.state()[0].collect()}
    assert got == {1: ("active", 1, 50), 2: ("completed", 2, 40), 3: ("queued", 0, 900)}
    now = 200
    for attempt in range(2, 6):
        assert [(r["job_id"], r["attempts"]) for r in log.claim("c", now, most=9, lease_ms=1).collect() if r["job_id"] == 1] == [(1, attempt)]
        now = log.fail("c", [1], now, "no luck").head()["run_at"] + (1000 if attempt == 5 else 0)
    row = log.state()[0].where("job_id = 1").head()
    assert (row["status"], row["attempts"], row["error"], row["worker"]) == ("failed", 5, "no luck", None)
    before = sorted(map(tuple, log.state()[0].collect()), key=str)
    log.compact()
    assert sorted(map(tuple, log.state()[0].collect()), key=str) == before
    assert len(log._commits()) == 1
    assert _ids(log.claim("c", 10**7, most=9)) == [3]


def test_writers_at_once_never_hold_the_same_job(spark, tmp_path):
    ClaimLog(spark, str(tmp_path)).enqueue(_jobs(spark, 12))
    held, barrier = {}, threading.Barrier(4)

    def work(name):
        log, held[name] = ClaimLog(spark.newSession(), str(tmp_path)), []
        barrier.wait()
        while ids := _ids(log.claim(name, 1000, most=2)):
            held[name] += ids

    workers = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert sorted(i for ids in held.values() for i in ids) == list(range(12))
    assert sum(map(bool, held.values())) > 1  # they did race


WORKER = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from lexilake.operators.claims import ClaimLog
path, barrier, name = sys.argv[1:]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.driver.memory", "1g").getOrCreate()
log = ClaimLog(spark, path)
Path(barrier, name).touch()
while len(list(Path(barrier).iterdir())) < 2:
    time.sleep(0.05)
while rows := log.claim(name, 1000, most=1).collect():
    print("HELD", rows[0]["job_id"], flush=True)
"""


def test_processes_at_once_never_hold_the_same_job(spark, tmp_path):
    path, barrier = tmp_path / "log", tmp_path / "barrier"
    barrier.mkdir()
    ClaimLog(spark, str(path)).enqueue(_jobs(spark, 8))
    began = time.time()
    runs = [subprocess.Popen([sys.executable, "-c", WORKER, str(path), str(barrier), f"p{k}"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for k in range(2)]
    held = [[int(x.split()[1]) for x in run.communicate(timeout=300 - (time.time() - began))[0].splitlines() if x.startswith("HELD")] for run in runs]
    assert sorted(held[0] + held[1]) == list(range(8))
