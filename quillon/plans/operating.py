"""Queries about changes, rounds, gauges, alerts, credentials and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.functions import text
from quillon.operators import admission, alerts, bulk, changes, dispatch, lists, rounds
from quillon.sources.views import DAY, HOUR, MINUTE, NOW, SECOND

from .listing import ROLLUP
from .observing import START
from .registry import Tables, query
from .scheduling import CRON_FIRES


@query(f"SELECT s.id, {NOW} + s.every AS next_fire_at FROM schedules s WHERE s.kind = 'fixed_delay' AND s.state IN ('ACTIVE', 'PAUSED') AND s.next_fire_at IS NULL AND s.id IN (SELECT schedule_id FROM job_history WHERE schedule_id IS NOT NULL)", "schedules job_history")
def advance_fixed_delay(t: Tables) -> DataFrame:
    return changes.advance_fixed_delay(t.schedules, t.job_history.where("schedule_id is not null").select("schedule_id"), NOW)


@query(
    f"""WITH {CRON_FIRES}, s AS (SELECT *, CASE WHEN id % 3 = 0 THEN anchor + 60 * CAST({DAY} AS BIGINT) END AS start_at FROM schedules), f AS (SELECT *, CASE WHEN start_at > {NOW} THEN start_at - 1 ELSE {NOW} END AS b, coalesce(start_at, created_at) AS a FROM s)
    SELECT id, CASE kind WHEN 'cron' THEN (SELECT min(c.f) FROM cron_fires c WHERE c.expr = f.expr AND c.f > f.b) WHEN 'fixed_delay' THEN b + 1 ELSE CASE WHEN b < a THEN a ELSE a + ((b - a) // every + 1) * every END END AS next_fire_at FROM f""",
    "schedules",
)
def first_fire(t: Tables) -> DataFrame:
    return changes.first_fire(t.schedules.withColumn("start_at", F.when(F.col("id") % 3 == 0, F.col("anchor") + 60 * DAY)), NOW)


ACTION = "CASE id % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'delete' ELSE 'trigger' END AS action"


def _acted(t: Tables) -> DataFrame:
    return t.schedules.withColumn("action", F.element_at(F.array(*(F.lit(a) for a in ("pause", "resume", "delete", "trigger"))), (F.col("id") % 4 + 1).cast("int")))


@query(
    f"""WITH s AS (SELECT *, {ACTION} FROM schedules), w AS (SELECT schedule_id, count(*) AS n, min(fire_time) AS f FROM jobs WHERE state = 'SCHEDULED' AND run_at > {NOW} AND schedule_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT s.*, w.n, w.f, CASE WHEN action = 'pause' AND state = 'ACTIVE' THEN 'PAUSED' WHEN action = 'resume' AND state = 'PAUSED' THEN 'ACTIVE' WHEN action = 'delete' AND state <> 'DELETED' THEN 'DELETED' WHEN action = 'trigger' AND state <> 'DELETED' THEN state ELSE 'CONFLICT' END AS result
        FROM s LEFT JOIN w ON w.schedule_id = s.id)
    SELECT id, action, result, CASE WHEN result = 'DELETED' THEN NULL WHEN action = 'pause' AND result = 'PAUSED' THEN least(next_fire_at, f)
        WHEN action = 'resume' AND result = 'ACTIVE' AND kind = 'fixed_delay' AND next_fire_at IS NULL AND id NOT IN (SELECT schedule_id FROM jobs WHERE schedule_id IS NOT NULL) THEN {NOW} ELSE next_fire_at END AS next_fire_at,
    CASE WHEN action = 'trigger' AND result <> 'CONFLICT' THEN {NOW} END AS fire_time, CASE WHEN (action = 'pause' AND result = 'PAUSED') OR result = 'DELETED' THEN coalesce(n, 0) ELSE 0 END AS withdrawn FROM r""",
    "schedules jobs",
)
def schedule_actions(t: Tables) -> DataFrame:
    return changes.schedule_actions(_acted(t), t.jobs, NOW)


@query(
    """WITH l AS (SELECT DISTINCT schedule_id, fire_time FROM all_jobs WHERE schedule_id IS NOT NULL)
    SELECT l.schedule_id, l.fire_time, CASE WHEN (l.schedule_id, l.fire_time + 1) NOT IN (SELECT schedule_id, fire_time FROM l) THEN l.fire_time + 1 ELSE l.fire_time + 2 END AS free FROM l""",
    "all_jobs",
)
def trigger_fire_times(t: Tables) -> DataFrame:
    """A trigger at the very time of a fire takes the next free microsecond."""
    ledger = t.all_jobs.where("schedule_id is not null").select("schedule_id", "fire_time").distinct()
    return changes.free_fire_time(ledger, ledger)


@query(
    f"""WITH beats AS (SELECT n_name AS node_id, {NOW} + n_nationkey * 1000000 AS seen, CASE WHEN n_nationkey % 3 = 0 THEN {NOW} + 5000000 END AS latest FROM nation UNION ALL SELECT r_name, {NOW} + r_regionkey * 1000000, CASE WHEN r_regionkey = 4 THEN {NOW} END FROM region),
    ok AS (SELECT node_id, max(seen) AS seen FROM beats WHERE latest IS NULL OR seen <= latest GROUP BY node_id)
    SELECT node_id, CASE WHEN n.stopped_at IS NOT NULL THEN n.beat_at ELSE coalesce(ok.seen, n.beat_at) END AS beat_at, n.stopped_at FROM engine_nodes n FULL JOIN ok USING (node_id)""",
    "engine_nodes",
)
def node_beats(t: Tables) -> DataFrame:
    at = lambda n: F.lit(NOW) + F.col(n).cast("long") * SECOND
    b = t.nation.select(F.col("n_name").alias("node_id"), at("n_nationkey").alias("at"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(NOW + 5 * SECOND)).alias("latest"))
    b = b.unionByName(t.region.select(F.col("r_name").alias("node_id"), at("r_regionkey").alias("at"), F.when(F.col("r_regionkey") == 4, F.lit(NOW)).alias("latest")))
    return changes.beat(t.engine_nodes, b)


@query(
    f"""WITH asks AS (SELECT 'pool:' || pool AS name, worker_id AS holder, id % 7 AS arrived, row_number() OVER (PARTITION BY pool ORDER BY id % 7, worker_id) AS n FROM worker_sessions)
    SELECT a.name, a.holder, a.n = 1 AND (l.expires_at IS NULL OR l.expires_at <= {NOW}) AS granted, CASE WHEN a.n = 1 AND (l.expires_at IS NULL OR l.expires_at <= {NOW}) THEN coalesce(l.epoch, 0) + 1 END AS epoch,
    CASE WHEN a.n = 1 AND (l.expires_at IS NULL OR l.expires_at <= {NOW}) THEN {NOW + 15 * SECOND} END AS expires_at FROM asks a LEFT JOIN leases l ON l.name = a.name""",
    "worker_sessions leases",
)
def acquire_leases(t: Tables) -> DataFrame:
    asks = t.worker_sessions.select(F.concat(F.lit("pool:"), "pool").alias("name"), F.col("worker_id").alias("holder"), (F.col("id") % 7).alias("arrived"))
    return changes.acquire(t.leases, asks, NOW, 15 * SECOND)


@query(
    f"""WITH log AS (SELECT id, pool AS name, tenant_id AS holder, {NOW} - id % 31 * 1000000 AS started, {NOW} - id % 31 * 1000000 + id % 9 * 900000 AS finished,
        CASE WHEN id % 6 < 3 THEN 'renewed' WHEN id % 6 = 3 THEN 'failed' WHEN id % 12 = 4 THEN 'lost' WHEN id % 12 = 5 THEN 'released' ELSE 'acquired' END AS outcome FROM jobs),
    told AS (SELECT *, CASE WHEN outcome IN ('acquired', 'renewed') THEN started + 8000000 END AS until FROM log WHERE outcome <> 'failed'),
    steps AS (SELECT *, lag(until) OVER w AS before, row_number() OVER (PARTITION BY name, holder ORDER BY started DESC, id DESC) AS back FROM told WINDOW w AS (PARTITION BY name, holder ORDER BY started, id)),
    last AS (SELECT name, holder, CASE WHEN outcome = 'renewed' AND (before IS NULL OR finished >= before) THEN NULL ELSE until END AS held_until FROM steps WHERE back = 1)
    SELECT name, holder, held_until, coalesce(held_until > {NOW}, false) AS held FROM last""",
    "jobs",
)
def held_leases(t: Tables) -> DataFrame:
    """Leases that their holders may act on by a log of requests."""
    n = F.col("id")
    outcome = F.when(n % 6 < 3, "renewed").when(n % 6 == 3, "failed").when(n % 12 == 4, "lost").when(n % 12 == 5, "released").otherwise("acquired")
    started = F.lit(NOW) - n % 31 * SECOND
    log = t.jobs.select("id", F.col("pool").alias("name"), F.col("tenant_id").alias("holder"), started.alias("started"), (started + n % 9 * 900_000).alias("finished"), outcome.alias("outcome"))
    return changes.held_until(log, NOW)


@query(
    """SELECT state, kind, count(*) AS n, CASE kind WHEN 'cancel' THEN state IN ('SCHEDULED', 'READY', 'RUNNING', 'RETRY_PENDING', 'PAUSED') WHEN 'redrive' THEN state IN ('FAILED', 'DEAD_LETTERED') ELSE false END AS valid
    FROM (SELECT state, CASE id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'redrive' ELSE 'other' END AS kind FROM all_jobs) GROUP BY ALL""",
    "all_jobs",
)
def operation_validity(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("cancel"), F.lit("redrive"), F.lit("other")), (F.col("id") % 3 + 1).cast("int"))
    return t.all_jobs.groupBy("state", kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("valid", changes.valid_operation(F.col("kind"), F.col("state")))


@query("SELECT team, count(*) AS matched, count(*) FILTER (WHERE state IN ('FAILED', 'DEAD_LETTERED')) AS succeeded, count(*) FILTER (WHERE state NOT IN ('FAILED', 'DEAD_LETTERED')) AS skipped FROM all_jobs WHERE team IS NOT NULL GROUP BY ALL", "all_jobs")
def bulk_redrive(t: Tables) -> DataFrame:
    from quillon.operators import states

    done = states.lifecycle(t.all_jobs.where("team is not null").withColumn("action", F.lit("retry")), NOW)
    return done.groupBy("team").agg(F.count("*").alias("matched"), F.count_if(F.col("result") == "READY").alias("succeeded"), F.count_if(F.col("result") == "CONFLICT").alias("skipped"))


#: Operations that get a batch, and jobs of a batch.
NODES, BATCH = 12, 20
JOBS_OF_BATCH = f"""open AS (SELECT * FROM operations WHERE state IN ('PENDING', 'RUNNING') ORDER BY created_at, id LIMIT {NODES}),
    j AS (SELECT *, CASE WHEN id % 2 = 0 THEN CAST(id % 50 AS VARCHAR) END AS dedupe_key, CASE WHEN id % 23 = 0 THEN 'lost ' || id END AS error FROM all_jobs),
    page AS (SELECT * FROM (SELECT o.id AS operation_id, o.kind, j.*, row_number() OVER (PARTITION BY o.id ORDER BY j.created_at DESC, j.id DESC) AS n FROM open o JOIN j ON j.tenant_id = o.tenant_id
        WHERE (j.created_at, j.id) < (o.cursor_created_at, o.cursor_id) AND (o.kind = 'redrive' OR j.state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTERED', 'CANCELLED'))
        AND coalesce(j.state = o.only_state, true) AND coalesce(j.job_type = o.job_type, true) AND (o.team IS NULL OR coalesce(j.team = o.team, false))) WHERE n <= {BATCH + 1}),
    held AS (SELECT DISTINCT tenant_id, dedupe_key FROM j WHERE dedupe_key IS NOT NULL AND state IN ('SCHEDULED', 'READY', 'RUNNING', 'RETRY_PENDING', 'PAUSED')),
    decided AS (SELECT p.*, CASE WHEN kind = 'cancel' THEN CASE WHEN cancel_requested_at IS NULL THEN 'succeeded' ELSE 'skipped' END
        WHEN state NOT IN ('FAILED', 'DEAD_LETTERED') THEN 'skipped'
        WHEN EXISTS (SELECT 1 FROM held h WHERE h.tenant_id = p.tenant_id AND h.dedupe_key = p.dedupe_key) THEN 'failed'
        WHEN EXISTS (SELECT 1 FROM page q WHERE q.kind = 'redrive' AND q.state IN ('FAILED', 'DEAD_LETTERED') AND q.tenant_id = p.tenant_id AND q.dedupe_key = p.dedupe_key AND (q.operation_id, q.n) < (p.operation_id, p.n)) THEN 'failed'
        ELSE 'succeeded' END AS outcome FROM page p)"""


def _batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.when(F.col("id") % 2 == 0, (F.col("id") % 50).cast("string"))
    jobs = t.all_jobs.withColumn("dedupe_key", key).withColumn("error", F.when(F.col("id") % 23 == 0, F.concat(F.lit("lost "), F.col("id").cast("string"))))
    return bulk.run_batch(t.operations, jobs, NOW, NODES, BATCH)


@query(f"WITH {JOBS_OF_BATCH} SELECT operation_id, n, id, outcome FROM decided", "operations all_jobs")
def bulk_batch(t: Tables) -> DataFrame:
    """The next jobs of each open operation and what becomes of them."""
    return _batch(t)[0].select("operation_id", "n", "id", "outcome")


@query(
    f"""WITH {JOBS_OF_BATCH}, stopped AS (SELECT operation_id, min(n) AS stop FROM decided WHERE error IS NOT NULL AND n <= {BATCH} GROUP BY operation_id),
    handled AS (SELECT d.* FROM decided d LEFT JOIN stopped s ON s.operation_id = d.operation_id WHERE d.n <= {BATCH} AND (s.stop IS NULL OR d.n < s.stop)),
    x AS (SELECT o.*, (SELECT d.error FROM decided d JOIN stopped s ON s.operation_id = d.operation_id AND d.n = s.stop WHERE d.operation_id = o.id) AS error,
        (SELECT count(*) > {BATCH} FROM page p WHERE p.operation_id = o.id) AS more, (SELECT max(n) FROM handled h WHERE h.operation_id = o.id) AS upto,
        (SELECT count(*) FROM handled h WHERE h.operation_id = o.id AND outcome = 'succeeded') AS s, (SELECT count(*) FROM handled h WHERE h.operation_id = o.id AND outcome = 'skipped') AS k,
        (SELECT count(*) FROM handled h WHERE h.operation_id = o.id AND outcome = 'failed') AS f FROM open o),
    y AS (SELECT x.*, CASE WHEN error IS NULL THEN 0 ELSE consecutive_errors + 1 END AS errors FROM x),
    z AS (SELECT *, CASE WHEN errors >= 10 THEN 'FAILED' WHEN error IS NOT NULL OR more THEN 'RUNNING' ELSE 'SUCCEEDED' END AS new_state FROM y)
    SELECT z.id, new_state AS state, coalesce(h.created_at, z.cursor_created_at) AS cursor_created_at, coalesce(h.id, z.cursor_id) AS cursor_id, CAST(succeeded + s AS BIGINT) AS succeeded, CAST(skipped + k AS BIGINT) AS skipped, CAST(failed + f AS BIGINT) AS failed,
    CAST(errors AS BIGINT) AS consecutive_errors, coalesce(z.error, last_error) AS last_error, CASE WHEN new_state <> 'RUNNING' THEN {NOW} END AS finished_at
    FROM z LEFT JOIN handled h ON h.operation_id = z.id AND h.n = z.upto""",
    "operations all_jobs",
)
def bulk_progress(t: Tables) -> DataFrame:
    """Cursor, counts and state of each open operation after a batch, some of which break off at an error."""
    return _batch(t)[1]


@query(
    f"""SELECT tenant_id, 'engine' AS actor, 'job.expire' AS action, CAST(id AS VARCHAR) AS target, '{{"pool":"' || pool || '","attempts":' || attempt_count || '}}' AS details, {NOW} AS created_at FROM jobs
    WHERE state IN ('SCHEDULED', 'READY') AND attempt_count = 0 AND start_deadline <= {NOW}""",
    "jobs",
)
def audit_of_expiry(t: Tables) -> DataFrame:
    gone = t.jobs.where(dispatch.overdue_start(NOW))
    return changes.audit(gone, "tenant_id", "engine", F.lit("job.expire"), "id", F.struct("pool", F.col("attempt_count").alias("attempts")), NOW)


@query(
    """SELECT id, name, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN NULL ELSE 7 END ELSE max_running END AS max_running, CASE WHEN id % 3 = 0 THEN 99 ELSE max_pending END AS max_pending FROM tenants""",
    "tenants",
)
def patch_quotas(t: Tables) -> DataFrame:
    patch = t.tenants.select("id", F.when(F.col("id") % 4 == 0, None).otherwise(7).alias("max_running"), (F.col("id") % 2 == 0).alias("set_max_running"), F.lit(99).alias("max_pending"), (F.col("id") % 3 == 0).alias("set_max_pending"))
    return changes.overlay(t.tenants, patch, "id", ["max_running", "max_pending"]).select("id", "name", "max_running", "max_pending")


@query(
    """SELECT id, '{"id":' || id || ',"state":"' || state || '"' || CASE WHEN team IS NOT NULL THEN ',"team":"' || team || '"' ELSE '' END || CASE WHEN start_deadline IS NOT NULL THEN ',"start_deadline":' || start_deadline ELSE '' END || '}' AS body FROM jobs""",
    "jobs",
)
def job_responses(t: Tables) -> DataFrame:
    return t.jobs.select("id", changes.response(F.col("id"), F.col("state"), F.col("team"), F.col("start_deadline")).alias("body"))


@query(
    f"""WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN {NOW - DAY} END AS revoked_at, CASE WHEN c_custkey % 3 = 0 THEN {NOW} + (c_custkey % 5 - 2) * {HOUR} END AS expires_at FROM customer)
    SELECT id, revoked_at IS NULL AND (expires_at IS NULL OR {NOW} < expires_at) AS usable FROM k""",
)
def usable_credentials(t: Tables) -> DataFrame:
    k = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, F.lit(NOW - DAY)).alias("revoked_at"), F.when(F.col("c_custkey") % 3 == 0, F.lit(NOW) + (F.col("c_custkey") % 5 - 2) * HOUR).alias("expires_at"))
    return k.select("id", admission.usable(NOW).alias("usable"))


@query("SELECT id, left(body, 2) AS short, octet_length(encode(left(body, 2))) AS bytes FROM submissions", "submissions")
def truncated_text(t: Tables) -> DataFrame:
    s = t.submissions.select("id", text.truncate_utf8(F.col("body"), F.lit(2)).alias("short"))
    return s.withColumn("bytes", F.octet_length("short").cast("long"))


@query(
    f"""WITH due AS (SELECT id, schedule_id, fire_time, run_at FROM jobs WHERE state = 'SCHEDULED' AND schedule_id IS NOT NULL AND run_at <= {NOW + 400 * DAY}),
    first AS (SELECT id FROM due ORDER BY run_at, id LIMIT 60),
    marked AS (SELECT d.*, d.id IN (SELECT id FROM first) AS batch FROM due d),
    whole AS (SELECT DISTINCT b.schedule_id FROM marked b JOIN marked o ON o.schedule_id = b.schedule_id AND (o.fire_time, o.id) < (b.fire_time, b.id) AND NOT o.batch WHERE b.batch)
    SELECT id, schedule_id, fire_time, batch FROM marked WHERE batch OR schedule_id IN (SELECT schedule_id FROM whole)""",
    "jobs",
)
def promotion_batch(t: Tables) -> DataFrame:
    return changes.batch_due(t.jobs, NOW + 400 * DAY, 60)


GAUGES = f"""WITH {ROLLUP}, running AS (SELECT pool, tenant_id, count(*) AS n FROM jobs WHERE state = 'RUNNING' GROUP BY ALL),
free AS (SELECT r.*, CASE WHEN t.max_running IS NOT NULL THEN greatest(0, t.max_running - coalesce(x.n, 0)) END AS allowance, sum(r.n) OVER (PARTITION BY r.pool, r.tenant_id) AS total,
    coalesce(sum(r.n) OVER (PARTITION BY r.pool, r.tenant_id ORDER BY r.priority DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM rollup r LEFT JOIN tenants t ON t.id = r.tenant_id LEFT JOIN running x ON x.pool = r.pool AND x.tenant_id = r.tenant_id WHERE held = ''),
taken AS (SELECT *, allowance IS NOT NULL AND allowance < total AS over, CASE WHEN allowance IS NOT NULL AND allowance < total THEN greatest(0, least(n, allowance - before)) ELSE n END AS take FROM free),
s AS (SELECT w.pool, least(coalesce(r.n, 0), w.slots) AS busy, w.slots - least(coalesce(r.n, 0), w.slots) AS free FROM worker_sessions w LEFT JOIN (SELECT session_id, count(*) AS n FROM jobs WHERE state = 'RUNNING' GROUP BY ALL) r ON r.session_id = w.id WHERE w.state = 'ACTIVE')
SELECT 'jobs_ready' AS name, pool, CAST(priority AS VARCHAR) AS label, CAST(sum(take) AS DOUBLE) AS value FROM taken GROUP BY pool, priority
UNION ALL SELECT 'jobs_held', pool, held, CAST(sum(n) AS DOUBLE) FROM rollup WHERE held <> '' GROUP BY pool, held
UNION ALL SELECT 'jobs_held', pool, 'tenant_cap', CAST(sum(n - take) AS DOUBLE) FROM taken GROUP BY pool HAVING sum(n - take) > 0
UNION ALL SELECT 'jobs_oldest_ready_age', pool, '', ({NOW} - min(due)) / 1000000 FROM taken WHERE NOT over GROUP BY pool
UNION ALL SELECT 'jobs_running', pool, CAST(tenant_id AS VARCHAR), CAST(n AS DOUBLE) FROM running
UNION ALL SELECT 'worker_slots', pool, 'busy', CAST(sum(busy) AS DOUBLE) FROM s GROUP BY pool UNION ALL SELECT 'worker_slots', pool, 'free', CAST(sum(free) AS DOUBLE) FROM s GROUP BY pool"""


@query(GAUGES, "jobs pools job_types tenants worker_sessions")
def pool_gauges(t: Tables) -> DataFrame:
    """Every gauge that a pool's owner reports, as series."""
    ready = lists.ready_rollup(t.jobs, t.job_types, t.pools, dispatch.claimable(NOW))
    found = lists.classify_backlog(ready, dispatch.allowances(t.jobs, t.tenants))
    return changes.gauges(ready, found, t.jobs, lists.sessions_overview(t.worker_sessions, t.jobs), NOW)


def _waiters(t: Tables) -> DataFrame:
    """All active sessions, some of which take certain types only."""
    kinds = F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return t.worker_sessions.where("state = 'ACTIVE' and not draining").select("pool", F.col("id").alias("session_id"), (F.col("id") % 17).alias("arrived"), "slots", kinds.alias("types"))


@query()
def dispatch_round(t: Tables) -> DataFrame:
    """A round for all active sessions; the fold is held against a plain model in the tests."""
    return rounds.dispatch_round(t.jobs, _waiters(t), t.tenants, t.job_types, t.pools, NOW)


@query()
def selector_memory(t: Tables) -> DataFrame:
    """The selectors' credits after a round that went on from others; held against a plain model in the tests."""
    before = t.pools.select(F.col("name").alias("pool"), F.explode(F.array(*map(F.lit, rounds.URGENCY))).alias("priority"))
    before = before.withColumn("credit", (F.length("pool") * F.col("priority") % 7 - 3).cast("long"))
    return rounds.remembered(rounds.round_with_memory(t.jobs, _waiters(t), t.tenants, t.job_types, t.pools, NOW, before), before)


@query(
    f"""WITH memory AS (SELECT DISTINCT pool, tenant_id, tenant_id % 2 = 0 AS at_cap, CASE WHEN tenant_id % 3 = 0 THEN {NOW - HOUR} END AS freed_at FROM job_history),
    caps AS (SELECT DISTINCT j.pool, j.tenant_id, t.max_running - (SELECT count(*) FROM jobs r WHERE r.pool = j.pool AND r.tenant_id = j.tenant_id AND r.state = 'RUNNING') AS room FROM jobs j JOIN tenants t ON t.id = j.tenant_id AND t.max_running IS NOT NULL)
    SELECT pool, tenant_id, coalesce(c.room <= 0, m.at_cap) AS at_cap, CASE WHEN c.room > 0 AND m.at_cap THEN {NOW} ELSE m.freed_at END AS freed_at FROM memory m FULL JOIN caps c USING (pool, tenant_id)""",
    "job_history tenants jobs",
)
def caps_freed(t: Tables) -> DataFrame:
    """Which tenants are at their cap in which pool, and when a cap had room again."""
    memory = t.job_history.select("pool", "tenant_id").distinct().withColumn("at_cap", F.col("tenant_id") % 2 == 0).withColumn("freed_at", F.when(F.col("tenant_id") % 3 == 0, F.lit(NOW - HOUR)))
    return dispatch.cap_memory(memory, dispatch.allowances(t.jobs, t.tenants), NOW)


#: Fixed value: time between evaluations.
EVERY = 10 * SECOND


@query()
def alert_rules(t: Tables) -> DataFrame:
    """All alert rules over series made from the events, from the first sample to the first evaluation that sees the last one; held against goldens in the tests."""
    m = t.metrics
    first, last = m.agg(F.coalesce(F.min("ts"), F.lit(START)), F.coalesce(F.max("ts"), F.lit(START))).first()
    since, until = first // EVERY * EVERY, -(-last // EVERY) * EVERY
    age = m.select(F.lit("jobs_oldest_ready_age_seconds").alias("name"), F.create_map(F.lit("pool"), F.col("outcome")).alias("labels"), "ts", (F.col("seconds") * 100).alias("value"))
    target = m.select(F.lit("pool_backlog_target_seconds").alias("name"), F.create_map(F.lit("pool"), F.col("outcome")).alias("labels"), "ts", F.lit(250.0).alias("value"))
    free = m.select(F.lit("worker_slots").alias("name"), F.create_map(F.lit("pool"), F.col("outcome"), F.lit("state"), F.lit("free")).alias("labels"), "ts", F.col("seconds").alias("value"))
    ready = m.select(F.lit("jobs_ready").alias("name"), F.create_map(F.lit("pool"), F.col("outcome")).alias("labels"), "ts", F.lit(3.0).alias("value"))
    return alerts.evaluate(age.unionByName(target).unionByName(free).unionByName(ready), since, until, EVERY)
