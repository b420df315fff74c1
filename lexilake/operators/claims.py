"""A job queue for several workers: an append-only log with one order, leases that run out.

Under one path ``data`` holds what attempts to write wrote, and ``commits`` one small
file for each that counts, named by its number. A writer reads the log up to commit n,
decides from the jobs' state there, writes its rows, and creates commit n + 1, which
only one writer can; who comes second reads on and decides anew. So every decision
holds at its place in the log, and no two workers hold a job at the same time.
A job's state is its last row. ``compact`` writes all states as one commit, from which
readers start; so what a reader lists and reads is bounded by how often that is done.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions import times as TM

COLUMNS = "job_id bigint, status string, attempts int, run_at bigint, worker string, held_until bigint, error string"
#: A job fails for good after so many attempts.
ATTEMPTS = 5
#: Times that a writer reads on because another was first.
RETRIES = 1000


class ClaimLog:
    """The jobs under ``path``: a folder of the file system that all workers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/commits"))

    def _put(self, number: int, said: str) -> bool:
        """Create the commit of this number with its content, whole or not at all; False if there is one."""
        jvm = self.spark._jvm
        to, draft = self._hadoop.Path(f"{self.path}/commits/{number:020d}"), self._hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(said.encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a rename there may replace a file, a link cannot
                nio = lambda p: jvm.java.nio.file.Paths.get(p.toUri())
                jvm.java.nio.file.Files.createLink(nio(self._fs.makeQualified(to)), nio(self._fs.makeQualified(draft)))
            else:
                context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, to, self.spark._jvm.PythonUtils.toArray([self._hadoop.Options.Rename.NONE]))
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    def _commits(self) -> list[tuple[int, str, str]]:
        """Number, attempt and kind of the commits from the last compacted one on."""
        found = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/commits")) if s.getPath().getName().isdigit())
        out = []
        for n in reversed(found):
            source = self._fs.open(self._hadoop.Path(f"{self.path}/commits/{n:020d}"))
            try:
                attempt, kind = bytes(source.readAllBytes()).decode().split()
            finally:
                source.close()
            out.append((n, attempt, kind))
            if kind == "all":
                break
        return out[::-1]

    def state(self) -> tuple[DataFrame, int]:
        """Each job as it is (``COLUMNS``), and the number of the last commit."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], COLUMNS), 0
        rows = self.spark.read.schema(f"{COLUMNS}, commit bigint").parquet(*[f"{self.path}/data/{a}" for _, a, _ in commits])
        names = [c.split()[0] for c in COLUMNS.split(", ")][1:]
        last = rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "commit").alias("x"))
        return last.select("job_id", "x.*"), commits[-1][0]

    def _commit(self, decide: Callable[[DataFrame], DataFrame], kind: str = "some") -> DataFrame:
        """Append the rows that ``decide`` makes of the jobs' state; nothing is committed if there are none."""
        for retry in range(RETRIES):
            jobs, last = self.state()
            attempt = uuid.uuid4().hex
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            decide(jobs).select(*names, F.lit(last + 1).cast("bigint").alias("commit")).coalesce(1).write.parquet(f"{self.path}/data/{attempt}")
            rows = self.spark.read.schema(COLUMNS).parquet(f"{self.path}/data/{attempt}")
            if rows.isEmpty() or self._put(last + 1, f"{attempt} {kind}"):
                return rows
            time.sleep(0.01 * (1 + retry % 7))
        raise TimeoutError(f"other writers were first {RETRIES} times")

    def enqueue(self, jobs: DataFrame) -> DataFrame:
        """Add jobs (``job_id``, ``run_at``); those that are known stay as they are, and null ids are left out."""

        def decide(known: DataFrame) -> DataFrame:
            new = jobs.where("job_id is not null").groupBy(F.col("job_id").cast("bigint").alias("job_id")).agg(F.min("run_at").cast("bigint").alias("run_at")).join(known.select("job_id"), "job_id", "left_anti")
            return new.selectExpr("job_id", "'queued' as status", "0 as attempts", "run_at", "cast(null as string) as worker", "cast(null as bigint) as held_until", "cast(null as string) as error")

        return self._commit(decide)

    def claim(self, worker: str, now: int, most: int = 1, lease_ms: int = 60_000) -> DataFrame:
        """The oldest due jobs (by run_at, then id), held by ``worker`` until the lease runs out; jobs whose lease ran out are due again."""
        lapsed = (F.col("status") == "active") & (F.col("held_until") <= now)

        def decide(jobs: DataFrame) -> DataFrame:
            due = jobs.where(((F.col("status") == "queued") & (F.col("run_at") <= now)) | lapsed).orderBy("run_at", "job_id").limit(most)
            return due.withColumns({"status": F.lit("active"), "attempts": F.col("attempts") + 1, "worker": F.lit(worker), "held_until": F.lit(now + lease_ms).cast("bigint")})

        return self._commit(decide)

    def _end(self, worker: str, ids: list[int], now: int, ended: Callable[[DataFrame], DataFrame]) -> DataFrame:
        mine = (F.col("status") == "active") & (F.col("worker") == worker) & (F.col("held_until") > now) & F.col("job_id").isin(ids)
        nobody = {"worker": F.lit(None).cast("string"), "held_until": F.lit(None).cast("bigint")}
        return self._commit(lambda jobs: ended(jobs.where(mine)).withColumns(nobody))

    def complete(self, worker: str, ids: list[int], now: int) -> DataFrame:
        """Those of the jobs that the worker still held, now completed; a job whose lease ran out is no longer its own."""
        return self._end(worker, ids, now, lambda own: own.withColumn("status", F.lit("completed")))

    def fail(self, worker: str, ids: list[int], now: int, error: str, attempts: int = ATTEMPTS) -> DataFrame:
        """Those that the worker still held: due again after their backoff, or failed after the last attempt."""
        spent = F.col("attempts") >= attempts

        def ended(own: DataFrame) -> DataFrame:
            return own.withColumns({
                "run_at": F.when(spent, F.col("run_at")).otherwise(now + TM.backoff(F.col("attempts"))).cast("bigint"),
                "status": F.when(spent, "failed").otherwise("queued"), "error": F.lit(error),
            })

        return self._end(worker, ids, now, ended)

    def compact(self) -> None:
        """Write the state of all jobs as one commit; earlier ones are no longer read."""
        self._commit(lambda jobs: jobs, "all")
