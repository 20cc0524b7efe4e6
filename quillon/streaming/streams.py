"""The same computations, incrementally: rollups, de-duplication, rate limits, leases and the scheduler's tick as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND = 1_000_000


def rollup(events: DataFrame, by: list[str], value: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Windowed counts and maxima; events later than ``late`` are dropped, state older than that too."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return e.groupBy(w, *by).agg(F.count("*").alias("n"), F.max(value).alias("top")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "top")


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Activity without a pause longer than ``gap``."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_submissions(requests: DataFrame, ttl: str = "24 hours", at: str = "ts") -> DataFrame:
    """The first request of each idempotency key within its time to live."""
    return requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, ttl).dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"])


BUCKET = "tenant_id int, id long, allowed boolean, wait double"


def token_bucket(requests: DataFrame, burst: float = 2.0, late: str = "1 hour") -> DataFrame:
    """Requests (tenant_id, ts in microseconds, id, rate) through a bucket a tenant; the state is two numbers, dropped once the bucket is full again by event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])  # one trigger's requests of one tenant; sources bound what a trigger takes
        out = []
        for ts, id_, rate in zip(rows["ts"], rows["id"], rows["rate"], strict=True):
            full = burst * rate
            tokens = full if tokens is None else min(full, tokens + max(0, ts - last) / SECOND * rate)
            last = int(ts) if last is None else max(last, int(ts))
            allowed = tokens >= 1
            out.append((key[0], id_, allowed, 0.0 if allowed else (1 - tokens) / rate))
            tokens -= allowed
        state.update((float(tokens), last))
        state.setTimeoutTimestamp(max(last // 1000 + int(burst * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["tenant_id", "id", "allowed", "wait"])

    timed = requests.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late)
    return timed.groupBy("tenant_id").applyInPandasWithState(step, BUCKET, "tokens double, last long", "append", GroupStateTimeout.EventTimeTimeout)


LEASE = "name string, seq long, holder string, action string, granted boolean, epoch long, expires_at long"


def decide_lease(state: tuple | None, holder: str, action: str, at: int, ttl: int, epoch: int | None) -> tuple[bool, tuple | None]:
    """One request to a lease. State: (holder, epoch, expires_at).

    Acquire takes a free or expired lease with the next epoch; its holder may take it again. Renew needs holder and
    epoch, even after the end, as long as nobody else has taken it. Release ends it and keeps the epoch.
    """
    if action == "acquire":
        if state is None or state[2] <= at:
            return True, (holder, (state[1] if state else 0) + 1, at + ttl)
        return False, state
    held = state is not None and state[0] == holder and state[1] == epoch
    if not held:
        return False, state
    return True, (holder, epoch, at + ttl if action == "renew" else at)


def leases(requests: DataFrame, ttl: int = 15 * SECOND) -> DataFrame:
    """A log of requests (name, seq, holder, action, at, epoch) folded into what each was granted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples():
            granted, now = decide_lease(now, r.holder, r.action, int(r.at), ttl, None if pd.isna(r.epoch) else int(r.epoch))
            out.append((key[0], r.seq, r.holder, r.action, granted, now[1] if now else None, now[2] if now else None))
        if now:
            state.update(now)
        yield pd.DataFrame(out, columns=["name", "seq", "holder", "action", "granted", "epoch", "expires_at"])

    return requests.groupBy("name").applyInPandasWithState(step, LEASE, "holder string, epoch long, expires_at long", "append", GroupStateTimeout.NoTimeout)


class WarmUp:
    """Nothing expires until the store has answered for ``quiet`` microseconds without an error."""

    def __init__(self, quiet: int = 30 * SECOND):
        self.quiet, self.since = quiet, None

    def step(self, at: int, healthy: bool) -> bool:
        self.since = (self.since if self.since is not None else at) if healthy else None
        return self.since is not None and at - self.since >= self.quiet


def wanted(seen: DataFrame, now: int, ttl: int = 30 * SECOND) -> DataFrame:
    """Pools that were seen within twice the session's time to live."""
    return seen.groupBy("pool").agg(F.max("at").alias("at")).where(F.col("at") > now - 2 * ttl).select("pool")


def tick(spark: SparkSession, state_dir: str, steps: list[Callable[[DataFrame, int], DataFrame]], clock: Callable[[], int]):
    """A scheduler's tick for ``foreachBatch``: each batch of new jobs joins the table, the steps run in order over it, and the table is written anew beside the old one.

    A batch that is repeated after a failure finds its own number's folder complete and does nothing.
    """

    def path(n: int) -> str:
        return f"{state_dir}/batch={n}"

    def run(new: DataFrame, n: int) -> None:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))
        if there(path(n)):
            return
        last = next((k for k in range(n - 1, -1, -1) if there(path(k))), None)
        jobs = new if last is None else spark.read.parquet(path(last)).unionByName(new)
        now = clock()
        for step in steps:
            jobs = step(jobs, now)
        jobs.write.mode("overwrite").parquet(path(n))

    return run
