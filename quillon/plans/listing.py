"""Queries about lists, pools, sessions, backlogs, leases and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.operators import dispatch, lists, states
from quillon.sources.views import DAY, HOUR, NOW

from .dispatching import CLAIMABLE
from .registry import Tables, query


@query("SELECT id, tenant_id, state, source FROM (SELECT *, 'active' AS source FROM jobs UNION ALL SELECT *, 'history' FROM job_history) WHERE id IN (1, 6, 32, 33, 103, 4000)", "jobs job_history")
def job_lookup(t: Tables) -> DataFrame:
    """Point lookups through both tables; the key filter reaches both scans."""
    return lists.all_jobs(t.jobs, t.job_history).where(F.col("id").isin(1, 6, 32, 33, 103, 4000)).select("id", "tenant_id", "state", "source")


AFTER = (NOW - 300 * DAY, 5000)


@query(
    f"""SELECT id, created_at, state, team FROM (SELECT * FROM jobs UNION ALL SELECT * FROM job_history)
    WHERE job_type = 1 AND created_at >= {NOW - 900 * DAY} AND created_at < {NOW} AND (created_at, id) < ({AFTER[0]}, {AFTER[1]}) ORDER BY created_at DESC, id DESC LIMIT 51""",
    "jobs job_history",
)
def list_jobs_page(t: Tables) -> DataFrame:
    cond = lists.list_filter(job_type=1, since=NOW - 900 * DAY, until=NOW, after=AFTER)
    return lists.page(lists.all_jobs(t.jobs, t.job_history), cond, 50).select("id", "created_at", "state", "team")


@query(
    """SELECT id, replace(replace(rtrim(base64(CAST('{"t":' || created_at || ',"id":' || id || '}' AS BLOB)), '='), '+', '-'), '/', '_') AS cursor FROM jobs WHERE team = '2'""",
    "jobs",
)
def page_cursors(t: Tables) -> DataFrame:
    return t.jobs.where(lists.list_filter(label=("team", "2"))).select("id", lists.cursor(F.col("created_at"), F.col("id")).alias("cursor"))


@query("SELECT tenant_id, name, paused, enabled, attempt_timeout_ms FROM job_types WHERE tenant_id IN (3, 4, 5)", "job_types")
def list_job_types(t: Tables) -> DataFrame:
    return t.job_types.where(F.col("tenant_id").isin(3, 4, 5)).orderBy("tenant_id", "name").select("tenant_id", "name", "paused", "enabled", "attempt_timeout_ms")


@query("SELECT id, name, coalesce(max_running, -1) AS max_running, coalesce(max_pending, 1000) AS max_pending FROM tenants ORDER BY name LIMIT 1000", "tenants")
def list_tenants(t: Tables) -> DataFrame:
    return t.tenants.select("id", "name", F.coalesce("max_running", F.lit(-1)).alias("max_running"), F.coalesce("max_pending", F.lit(1000)).alias("max_pending")).orderBy("name").limit(1000)


@query("SELECT id, tenant_id, name, next_fire_at, state FROM schedules WHERE state <> 'DELETED' AND tenant_id = 7 ORDER BY created_at DESC, id DESC LIMIT 51", "schedules")
def list_schedules_page(t: Tables) -> DataFrame:
    return lists.page(t.schedules, (F.col("state") != "DELETED") & (F.col("tenant_id") == 7)).select("id", "tenant_id", "name", "next_fire_at", "state")


@query(
    """WITH ended AS (SELECT job_id, number, session_id, state, started_at, 0 AS last FROM attempts UNION ALL SELECT id, attempt_count, session_id, 'RUNNING', attempt_started_at, 1 FROM jobs WHERE state = 'RUNNING')
    SELECT e.job_id, e.number, e.state, e.started_at, e.last, s.worker_id FROM ended e LEFT JOIN worker_sessions s ON s.id = e.session_id""",
    "attempts jobs worker_sessions",
)
def list_attempts(t: Tables) -> DataFrame:
    found = lists.attempts_of(t.attempts, t.worker_sessions, t.jobs)
    return found.select("job_id", "number", "state", "started_at", "last", "worker_id")


@query(
    f"""WITH live AS (SELECT * FROM worker_sessions WHERE state = 'ACTIVE'),
    names AS (SELECT name FROM pools UNION SELECT pool FROM live UNION SELECT pool FROM jobs WHERE state IN ('READY', 'RUNNING'))
    SELECT n.name, coalesce(p.paused, false) AS paused, (SELECT count(*) FROM live s WHERE s.pool = n.name) AS workers, coalesce((SELECT CAST(sum(slots) AS BIGINT) FROM live s WHERE s.pool = n.name), 0) AS slots,
    (SELECT count(*) FROM jobs j WHERE j.pool = n.name AND j.state = 'READY') AS ready, (SELECT count(*) FROM jobs j WHERE j.pool = n.name AND j.state = 'RUNNING') AS running, l.holder
    FROM names n LEFT JOIN pools p ON p.name = n.name LEFT JOIN leases l ON l.name = 'pool:' || n.name AND l.expires_at > {NOW}""",
    "pools worker_sessions jobs leases",
)
def pools_overview(t: Tables) -> DataFrame:
    return lists.pools_overview(t.pools, t.worker_sessions, t.jobs, t.leases, NOW)


@query(
    """SELECT s.id, s.pool, s.state, s.draining, coalesce(r.n, 0) AS running, least(coalesce(r.n, 0), s.slots) AS busy, s.slots - least(coalesce(r.n, 0), s.slots) AS free
    FROM worker_sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM jobs WHERE state = 'RUNNING' GROUP BY ALL) r ON r.session_id = s.id""",
    "worker_sessions jobs",
)
def sessions_overview(t: Tables) -> DataFrame:
    return lists.sessions_overview(t.worker_sessions, t.jobs).select("id", "pool", "state", "draining", "running", "busy", "free")


ROLLUP = f"""rollup AS (SELECT j.pool, j.priority, j.tenant_id, CASE WHEN p.paused THEN 'pool_paused' WHEN y.paused THEN 'job_type_paused' ELSE '' END AS held, count(*) AS n, min(j.run_at) AS due
    FROM jobs j LEFT JOIN pools p ON p.name = j.pool LEFT JOIN job_types y ON y.tenant_id = j.tenant_id AND y.name = j.job_type WHERE {CLAIMABLE} GROUP BY ALL)"""


@query(f"WITH {ROLLUP} SELECT *, ({NOW} - due) / 1000000 AS age FROM rollup", "jobs pools job_types")
def ready_rollup(t: Tables) -> DataFrame:
    return lists.ready_rollup(t.jobs, t.job_types, t.pools, dispatch.claimable(NOW)).withColumn("age", (F.lit(NOW) - F.col("due")) / 1_000_000)


@query(
    f"""WITH {ROLLUP}, running AS (SELECT pool, tenant_id, count(*) AS n FROM jobs WHERE state = 'RUNNING' GROUP BY ALL),
    free AS (SELECT r.*, CASE WHEN t.max_running IS NOT NULL THEN greatest(0, t.max_running - coalesce(x.n, 0)) END AS allowance, sum(r.n) OVER (PARTITION BY r.pool, r.tenant_id) AS total,
        coalesce(sum(r.n) OVER (PARTITION BY r.pool, r.tenant_id ORDER BY r.priority DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM rollup r LEFT JOIN tenants t ON t.id = r.tenant_id LEFT JOIN running x ON x.pool = r.pool AND x.tenant_id = r.tenant_id WHERE held = ''),
    taken AS (SELECT *, allowance IS NOT NULL AND allowance < total AS over, CASE WHEN allowance IS NOT NULL AND allowance < total THEN greatest(0, least(n, allowance - before)) ELSE n END AS take FROM free)
    SELECT pool, priority, CAST(sum(take) AS BIGINT) AS ready, CAST(sum(n - take) AS BIGINT) AS held_cap, min(CASE WHEN NOT over THEN due END) AS oldest_due FROM taken GROUP BY ALL""",
    "jobs pools job_types tenants",
)
def classify_backlog(t: Tables) -> DataFrame:
    rollup = lists.ready_rollup(t.jobs, t.job_types, t.pools, dispatch.claimable(NOW))
    found = lists.classify_backlog(rollup, dispatch.allowances(t.jobs, t.tenants))
    return found.groupBy("pool", "priority").agg(F.sum("ready").alias("ready"), F.sum("held_cap").alias("held_cap"), F.min("due").alias("oldest_due"))


@query("SELECT tenant_id, count(*) AS running, count(*) FILTER (WHERE pool = 'BUILDING') AS in_pool FROM jobs WHERE state = 'RUNNING' AND tenant_id IN (SELECT id FROM tenants WHERE max_running IS NOT NULL) GROUP BY ALL", "jobs tenants")
def running_counts(t: Tables) -> DataFrame:
    capped = t.tenants.where("max_running is not null").select(F.col("id").alias("tenant_id"))
    return t.jobs.where("state = 'RUNNING'").join(capped, "tenant_id", "left_semi").groupBy("tenant_id").agg(F.count("*").alias("running"), F.count_if(F.col("pool") == "BUILDING").alias("in_pool"))


WANTED = """wanted AS (SELECT pool FROM worker_sessions WHERE state = 'ACTIVE' UNION SELECT s.pool FROM worker_sessions s WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.pool = s.pool AND j.state = 'READY'))"""


@query(f"WITH {WANTED} SELECT pool, NOT EXISTS (SELECT 1 FROM leases l WHERE l.name = 'pool:' || w.pool AND l.expires_at > {NOW}) AS unowned FROM wanted w", "worker_sessions jobs leases")
def wanted_pools(t: Tables) -> DataFrame:
    wanted = lists.wanted_pools(t.worker_sessions, t.jobs)
    free = lists.unowned(wanted, t.leases, NOW).select("pool").withColumn("unowned", F.lit(True))
    return wanted.join(free, "pool", "left").select("pool", F.coalesce("unowned", F.lit(False)).alias("unowned"))


@query("SELECT name, holder, epoch FROM leases WHERE (name, holder, epoch) IN (SELECT 'pool:' || pool, 'AMERICA', CAST(2 AS BIGINT) FROM worker_sessions)", "leases worker_sessions")
def fenced_writes(t: Tables) -> DataFrame:
    claims = t.worker_sessions.select(F.concat(F.lit("pool:"), "pool").alias("name"), F.lit("AMERICA").alias("holder"), F.lit(2).cast("long").alias("epoch")).distinct()
    return lists.holds_lease(claims, t.leases)


CUT = NOW - 1500 * DAY


#: When the keys of the submissions are looked at: they are younger than the jobs.
KEYS_AT = 1_704_067_200_000_000 + 10 * DAY


@query(
    f"""SELECT 'job_history' AS "table", count(*) AS rows FROM job_history WHERE finished_at < {CUT} UNION ALL SELECT 'attempts', count(*) FROM attempts WHERE finished_at < {CUT}
    UNION ALL SELECT 'idempotency_keys', count(*) FROM (SELECT max(ts) + {DAY} AS expires_at FROM submissions WHERE idempotency_key IS NOT NULL GROUP BY tenant_id, idempotency_key) WHERE expires_at < {KEYS_AT}
    UNION ALL SELECT 'schedule_fires', count(*) FROM (SELECT DISTINCT schedule_id, fire_time FROM all_jobs WHERE schedule_id IS NOT NULL) WHERE fire_time < {CUT}
    UNION ALL SELECT 'worker_sessions', count(*) FROM worker_sessions WHERE state <> 'ACTIVE' AND lease_expires_at < {NOW - HOUR}
    UNION ALL SELECT 'engine_nodes', count(*) FROM engine_nodes WHERE beat_at < {NOW - HOUR}""",
    "job_history attempts submissions all_jobs worker_sessions engine_nodes",
)
def retention_report(t: Tables) -> DataFrame:
    """How many rows of each table a maintenance pass removes."""
    keys = t.submissions.where("idempotency_key is not null").groupBy("tenant_id", "idempotency_key").agg((F.max("ts") + DAY).alias("expires_at"))
    fires = t.all_jobs.where("schedule_id is not null").select("schedule_id", "fire_time")
    return lists.retention(
        {
            "job_history": (t.job_history, F.col("finished_at") < CUT),
            "attempts": (t.attempts, F.col("finished_at") < CUT),
            "idempotency_keys": (keys, F.col("expires_at") < KEYS_AT),
            "schedule_fires": (fires.where(F.col("fire_time") < CUT).distinct(), F.col("fire_time") < CUT),
            "worker_sessions": (t.worker_sessions, (F.col("state") != "ACTIVE") & (F.col("lease_expires_at") < NOW - HOUR)),
            "engine_nodes": (t.engine_nodes, F.col("beat_at") < NOW - HOUR),
        }
    )


@query(
    f"""SELECT id, CASE WHEN state IN ('SCHEDULED', 'READY') AND attempt_count = 0 AND start_deadline <= {NOW} THEN 'EXPIRED' ELSE state END AS state,
    CASE WHEN state IN ('SCHEDULED', 'READY') AND attempt_count = 0 AND start_deadline <= {NOW} THEN 'START_DEADLINE_EXCEEDED' END AS reason FROM jobs""",
    "jobs",
)
def expire_overdue(t: Tables) -> DataFrame:
    """Jobs past their start deadline move to history; the others stay."""
    stay, gone = lists.move(t.jobs, dispatch.overdue_start(NOW), state=F.lit("EXPIRED"), reason=F.lit("START_DEADLINE_EXCEEDED"))
    return stay.select("id", "state", F.lit(None).cast("string").alias("reason")).unionByName(gone.select("id", "state", "reason"))


@query(
    f"""SELECT team, count(*) AS matched, count(*) FILTER (WHERE state = 'RUNNING') AS asked, count(*) FILTER (WHERE state IN ('SCHEDULED', 'READY', 'RETRY_PENDING')) AS succeeded,
    count(*) FILTER (WHERE state NOT IN ('SCHEDULED', 'READY', 'RETRY_PENDING', 'RUNNING')) AS skipped FROM all_jobs WHERE team IS NOT NULL AND created_at < {NOW} GROUP BY ALL""",
    "all_jobs",
)
def bulk_cancel(t: Tables) -> DataFrame:
    """A bulk operation over jobs with a label that were created before it."""
    found = t.all_jobs.where(F.col("team").isNotNull() & (F.col("created_at") < NOW)).withColumn("action", F.lit("cancel"))
    done = states.lifecycle(found.withColumn("cancel_requested_at", F.lit(None).cast("long")), NOW)
    return done.groupBy("team").agg(F.count("*").alias("matched"), F.count_if(F.col("result") == "REQUESTED").alias("asked"), F.count_if(F.col("result") == "CANCELLED").alias("succeeded"), F.count_if(F.col("result").isin("CONFLICT", "UNCHANGED")).alias("skipped"))


@query(
    f"""SELECT id, state, priority FROM (SELECT * FROM (SELECT id, state, priority, row_number() OVER (PARTITION BY pool ORDER BY run_at, id) AS r FROM jobs WHERE state IN ('SCHEDULED', 'RETRY_PENDING') AND run_at <= {NOW} AND (schedule_id IS NULL OR state = 'RETRY_PENDING')) WHERE r <= 500)""",
    "jobs",
)
def promote_due(t: Tables) -> DataFrame:
    """Each pool's first five hundred due jobs."""
    return dispatch.first_of_each(t.jobs.where(dispatch.due(NOW)), ["pool"], [F.col("run_at"), F.col("id")], 500).select("id", "state", "priority")


@query(
    """WITH s AS (SELECT pool, state, draining, slots FROM worker_sessions) SELECT pool, count(*) AS sessions, CAST(sum(slots) AS BIGINT) AS slots,
    count(*) FILTER (WHERE state = 'ACTIVE' AND NOT draining) AS live, count(*) FILTER (WHERE state = 'ACTIVE' AND draining) AS draining, count(*) FILTER (WHERE state <> 'ACTIVE') AS gone FROM s GROUP BY ALL""",
    "worker_sessions",
)
def pool_sessions(t: Tables) -> DataFrame:
    live = F.col("state") == "ACTIVE"
    return t.worker_sessions.groupBy("pool").agg(F.count("*").alias("sessions"), F.sum("slots").alias("slots"), F.count_if(live & ~F.col("draining")).alias("live"), F.count_if(live & F.col("draining")).alias("draining"), F.count_if(~live).alias("gone"))


@query(
    """SELECT name, paused, 700000 AS backlog_target_ms FROM pools WHERE paused UNION ALL SELECT name, paused, CAST(coalesce(backlog_target_ms, 0) AS BIGINT) FROM pools WHERE NOT paused""",
    "pools",
)
def pool_settings_upsert(t: Tables) -> DataFrame:
    old = t.pools.withColumn("backlog_target_ms", F.coalesce("backlog_target_ms", F.lit(0)).cast("long"))
    new = old.where("paused").withColumn("backlog_target_ms", F.lit(700_000).cast("long"))
    return lists.upsert(old, new, ["name"])


@query(
    f"""SELECT CAST(floor(finished_at / {DAY * 30}.0) AS BIGINT) AS period, state, count(*) AS jobs, CAST(sum(CAST(round(size * 100) AS BIGINT)) AS BIGINT) AS cents, max(finished_at) AS latest FROM job_history GROUP BY ALL""",
    "job_history",
)
def history_by_period(t: Tables) -> DataFrame:
    """The partitions of the history and what they hold."""
    h = t.job_history.withColumn("period", F.floor(F.col("finished_at") / (DAY * 30)).cast("long"))
    return h.groupBy("period", "state").agg(F.count("*").alias("jobs"), F.sum(F.round(F.col("size") * 100).cast("long")).alias("cents"), F.max("finished_at").alias("latest"))
