"""A queue of downloads as a stream: one running job a site, a gap between requests, waits that grow, limits that hold a whole site back.

Jobs come as events with event times; a site's queue is state, and timers wake it. Nothing is decided before the watermark has
passed it, so the result doesn't depend on how events were cut into batches, and a restart from the checkpoint goes on where it was.

A job starts when its site is idle, the gap since the site's last request has passed, and its own wait is over; of several the
first in the queue. A failed job waits: the first wait, twice as long each time, ten minutes at most, or as long as a
site that asks to slow down says; then all its waiting jobs wait as long. After the last try, or where the
reader is needed, it has failed; where the reader is needed, so have the book's other jobs there.

Defined results: a job without a site, an id or a time is dropped; null numbers are 0 (no time taken, no failures), a null kind
of failure is a plain one; a job that comes when the watermark has reached its time is late and dropped; jobs of one time queue by their ids; a job that comes again under its id queues again; a start
after the watermark is told when the watermark gets there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Seconds between a site's requests, the first wait after a failure, the longest, and how often a job is tried.
PACE_S, BACKOFF_S, LONGEST_WAIT_S, TRIES = 2.0, 5.0, 600.0, 5
ATTEMPTS = "site string, job long, tried int, started double, ended double, outcome string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Site:
    """One site's queue; times are seconds."""

    def __init__(self, pace: float = PACE_S, backoff: float = BACKOFF_S, longest: float = LONGEST_WAIT_S, tries: int = TRIES, kept: dict | None = None):
        self.pace, self.backoff, self.longest, self.tries = pace, backoff, longest, tries
        kept = kept or {}
        #: Jobs that come later than now, and those in the queue, in its order; a job is [at, id, book, lasts, fails, kind, retry, ready, tried].
        self.coming, self.queue = kept.get("coming", []), kept.get("queue", [])
        self.now, self.last, self.running = kept.get("now", 0.0), kept.get("last"), kept.get("running")

    def kept(self) -> dict:
        return {"coming": self.coming, "queue": self.queue, "now": self.now, "last": self.last, "running": self.running}

    def add(self, jobs: list[list]) -> None:
        self.coming = sorted(self.coming + jobs, key=lambda j: (j[0], j[1]))

    def _ready(self, job: list) -> float:
        return max(job[7], self.last + self.pace) if self.last is not None else job[7]

    def next_time(self) -> float | None:
        """When something happens next, if nothing comes before."""
        if self.running:
            return min([self.running[1], *([self.coming[0][0]] if self.coming else [])])
        times = [max(self.now, min(self._ready(j) for j in self.queue))] if self.queue else []
        return min([*times, *([self.coming[0][0]] if self.coming else [])], default=None)

    def _ended(self) -> None:
        job, ended = self.running
        self.running, self.now, self.last = None, ended, ended
        if job[8] > job[4]:
            return  # done
        if job[5] == "reader" or job[8] >= self.tries:
            if job[5] == "reader":
                self.queue = [j for j in self.queue if j[2] != job[2]]
            return
        wait = min(self.longest, self.backoff * 2 ** (job[8] - 1))
        if job[5] == "limit":
            wait = max(wait, job[6])
            for j in self.queue:
                j[7] = ended + wait
        job[7] = ended + wait
        self.queue = sorted([*self.queue, job], key=lambda j: (j[0], j[1]))

    def until(self, line: float) -> Iterator[tuple[int, int, float, float, str]]:
        """Lets time pass up to a line; (job, try, started, ended, outcome) of each start."""
        while (t := self.next_time()) is not None and t <= line:
            if self.running and self.running[1] <= t:
                self._ended()
            elif self.coming and self.coming[0][0] <= t:
                self.now = max(self.now, t)
                self.queue.append(self.coming.pop(0))
            else:
                k = next(i for i, j in enumerate(self.queue) if self._ready(j) <= t)
                job = self.queue.pop(k)
                job[8] += 1
                self.now = self.last = t
                self.running = [job, t + job[3]]
                failed = job[8] <= job[4]
                gives_up = failed and (job[5] == "reader" or job[8] >= self.tries)
                yield job[1], job[8], t, t + job[3], "failed" if gives_up else "again" if failed else "done"


class _Queue(StatefulProcessor):
    def __init__(self, *settings):
        self.settings = settings

    def init(self, handle) -> None:
        self.handle = handle
        self.site = handle.getValueState("site", "kept string")

    def _pass(self, key, jobs, line) -> Iterator[pd.DataFrame]:
        site = Site(*self.settings, kept=json.loads(self.site.get()[0]) if self.site.exists() else None)
        site.add(jobs)
        out = [(key[0], *x) for x in site.until(line)]
        self.site.update((json.dumps(site.kept()),))
        then = site.next_time()
        if then is not None:
            self.handle.registerTimer(int(then * 1000) + 1)
        yield pd.DataFrame(out, columns=["site", "job", "tried", "started", "ended", "outcome"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs = [[r.at, int(r.job), r.book, r.lasts, int(r.fails), r.kind, r.retry, r.at, 0] for x in rows for r in x.itertuples(index=False)]
        yield from self._pass(key, jobs, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._pass(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def attempts(jobs: DataFrame, late: str = "0 seconds", pace: float = PACE_S, backoff: float = BACKOFF_S, longest: float = LONGEST_WAIT_S, tries: int = TRIES) -> DataFrame:
    """site, job, tried, started, ended (seconds), outcome (done, again, failed) of a stream of jobs (site, job, book, ts, lasts, fails, kind, retry).

    fails: how many tries fail; kind of failure: limit (the site asks to wait `retry` seconds), reader (someone is needed), else a plain one.
    The session's state store must be one with timers (STATE_STORE).
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    known = jobs.filter("site IS NOT NULL AND job IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = known.select(F.col("site").cast("string").alias("site"), F.col("job").cast("long").alias("job"), F.coalesce(F.col("book").cast("string"), F.lit("")).alias("book"), "ts", F.unix_micros("ts").cast("double").alias("_us"), number("lasts"), number("fails"), F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"), number("retry"))
    rows = rows.withColumn("at", F.col("_us") / 1e6).drop("_us")
    return rows.groupBy("site").transformWithStateInPandas(_Queue(pace, backoff, longest, tries), ATTEMPTS, "Append", "EventTime")
