"""Streaming queries, run to the end of what is there; their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.operators import dispatch, handlers
from quillon.sources import scratch
from quillon.streaming import streams

from .observing import START
from .registry import Tables, query


def _drain(t: Tables, out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has, into a table of files, and reads that."""
    where = scratch.folder(t.spark, "stream")
    out.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{where}/out")


def _events(t: Tables) -> DataFrame:
    batch = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    stream = t.spark.readStream.schema(batch.schema).parquet(f"{t.sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))  # whatever the session's zone


@query(
    f"""WITH w AS (SELECT CAST(floor((epoch_us(ts) - {START}) / 600000000.0) AS BIGINT) AS slot, event_type, value, epoch_us(ts) AS ts FROM events),
    last AS (SELECT max(ts) - 3600000000 AS mark FROM w)
    SELECT slot, event_type, count(*) AS n, max(value) AS top FROM w, last WHERE {START} + (slot + 1) * 600000000 <= mark GROUP BY ALL""",
)
def stream_rollup(t: Tables) -> DataFrame:
    """Ten-minute windows that the watermark has closed."""
    out = streams.rollup(_events(t), ["event_type"], "value")
    done = _drain(t, out)
    return done.select(F.floor((F.unix_micros("start") - START) / 600_000_000).cast("long").alias("slot"), "event_type", "n", "top")


@query(
    """WITH RECURSIVE r AS (SELECT epoch_us(ts) AS ts, CAST(user_id % 25 AS INT) AS tenant_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT ts, tenant_id, n, 2.0::DOUBLE AS had FROM r WHERE n = 1
        UNION ALL SELECT r.ts, r.tenant_id, r.n, least(2.0, CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END + CAST(r.ts - b.ts AS DOUBLE) / 43200000000.0) FROM b JOIN r ON r.tenant_id = b.tenant_id AND r.n = b.n + 1)
    SELECT tenant_id, count(*) AS asked, count(*) FILTER (WHERE had >= 1) AS allowed FROM b GROUP BY ALL""",
)
def stream_token_bucket(t: Tables) -> DataFrame:
    """A bucket of two requests a day for each tenant; the state is kept across triggers."""
    e = _events(t).select((F.col("user_id") % 25).cast("int").alias("tenant_id"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"), (F.lit(1.0) / 43200.0).alias("rate"))
    done = _drain(t, streams.token_bucket(e, burst=86400.0))
    return done.groupBy("tenant_id").agg(F.count("*").alias("asked"), F.count_if("allowed").alias("allowed"))


@query(
    """SELECT CASE WHEN id % 7 = 0 THEN 'FAILED' WHEN id % 7 = 1 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome, CASE WHEN id % 7 = 0 THEN false WHEN id % 7 = 1 THEN false END AS retryable, count(*) AS n
    FROM jobs WHERE state = 'RUNNING' GROUP BY ALL""",
    "jobs",
)
def handle_jobs(t: Tables) -> DataFrame:
    """Running jobs through the demonstration handler: one in seven has no address, one in seven no handler."""
    kind = F.when(F.col("id") % 7 == 1, "unknown").otherwise("email.send")
    payload = F.when(F.col("id") % 7 == 0, "{}").otherwise('{"to": "a@example.com"}')
    jobs = t.jobs.where("state = 'RUNNING'").select("id", kind.alias("job_type"), payload.alias("payload"), F.lit(None).cast("long").alias("timeout_ms"))
    done = handlers.execute(jobs, {"email.send": handlers.email_send})
    return done.groupBy("outcome", "retryable").agg(F.count("*").alias("n"))


@query(
    """SELECT j.id, CASE WHEN s.id IS NULL THEN 'no session' WHEN s.state <> 'ACTIVE' THEN 'lost' WHEN s.draining THEN 'draining' ELSE 'held' END AS standing FROM jobs j LEFT JOIN worker_sessions s ON s.id = j.session_id WHERE j.state = 'RUNNING'""",
    "jobs worker_sessions",
)
def running_standing(t: Tables) -> DataFrame:
    s = t.worker_sessions.select(F.col("id").alias("session_id"), F.col("state").alias("s"), "draining")
    j = t.jobs.where("state = 'RUNNING'").join(s, "session_id", "left")
    return j.select("id", F.when(F.col("s").isNull(), "no session").when(F.col("s") != "ACTIVE", "lost").when(F.col("draining"), "draining").otherwise("held").alias("standing"))


@query(
    """WITH RECURSIVE q AS (SELECT pool, CAST(sum(CASE WHEN priority = 4 THEN 1 ELSE 0 END) AS BIGINT) AS c4, CAST(sum(CASE WHEN priority = 3 THEN 1 ELSE 0 END) AS BIGINT) AS c3, CAST(sum(CASE WHEN priority = 2 THEN 1 ELSE 0 END) AS BIGINT) AS c2, CAST(sum(CASE WHEN priority = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c1 FROM jobs WHERE state = 'READY' GROUP BY pool),
    g AS (SELECT pool, 0 AS n, c4 AS l4, c3 AS l3, c2 AS l2, c1 AS l1, 0 AS r4, 0 AS r3, 0 AS r2, 0 AS r1, 0 AS pick FROM q
      UNION ALL SELECT pool, n + 1, l4 - CAST(p = 4 AS INT), l3 - CAST(p = 3 AS INT), l2 - CAST(p = 2 AS INT), l1 - CAST(p = 1 AS INT), a4 - CASE WHEN p = 4 THEN w ELSE 0 END, a3 - CASE WHEN p = 3 THEN w ELSE 0 END, a2 - CASE WHEN p = 2 THEN w ELSE 0 END, a1 - CASE WHEN p = 1 THEN w ELSE 0 END, p
      FROM (SELECT *, CASE WHEN l4 > 0 AND a4 >= CASE WHEN l3 > 0 THEN a3 ELSE -99 END AND a4 >= CASE WHEN l2 > 0 THEN a2 ELSE -99 END AND a4 >= CASE WHEN l1 > 0 THEN a1 ELSE -99 END THEN 4
            WHEN l3 > 0 AND a3 >= CASE WHEN l2 > 0 THEN a2 ELSE -99 END AND a3 >= CASE WHEN l1 > 0 THEN a1 ELSE -99 END THEN 3 WHEN l2 > 0 AND a2 >= CASE WHEN l1 > 0 THEN a1 ELSE -99 END THEN 2 ELSE 1 END AS p
        FROM (SELECT *, r4 + CASE WHEN l4 > 0 THEN 8 ELSE 0 END AS a4, r3 + CASE WHEN l3 > 0 THEN 4 ELSE 0 END AS a3, r2 + CASE WHEN l2 > 0 THEN 2 ELSE 0 END AS a2, r1 + CASE WHEN l1 > 0 THEN 1 ELSE 0 END AS a1,
            CASE WHEN l4 > 0 THEN 8 ELSE 0 END + CASE WHEN l3 > 0 THEN 4 ELSE 0 END + CASE WHEN l2 > 0 THEN 2 ELSE 0 END + CASE WHEN l1 > 0 THEN 1 ELSE 0 END AS w FROM g WHERE n < 40 AND l4 + l3 + l2 + l1 > 0)))
    SELECT pool, count(*) FILTER (WHERE pick = 4) AS critical, count(*) FILTER (WHERE pick = 3) AS high, count(*) FILTER (WHERE pick = 2) AS normal, count(*) FILTER (WHERE pick = 1) AS low FROM g GROUP BY pool""",
    "jobs",
)
def allocate_slots(t: Tables) -> DataFrame:
    """Forty slots of each pool shared out over its backlog by the selector with memory; a fold over one row a pool."""
    names = {4: "critical", 3: "high", 2: "normal", 1: "low"}
    counts = t.jobs.where("state = 'READY'").groupBy("pool").agg(*(F.sum((F.col("priority") == p).cast("long")).alias(names[p]) for p in names))

    def share(batches):
        for pdf in batches:
            got = [dispatch.allocate({p: int(r[names[p]]) for p in names}, 40) for r in pdf.to_dict("records")]
            for p, name in names.items():
                pdf[name] = [g[p] for g in got]
            yield pdf

    return counts.mapInPandas(share, counts.schema)
