"""Queries about submissions: idempotency, de-duplication, quotas, shedding, rate limits, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.functions import ids, text
from quillon.operators import admission
from quillon.sources.views import DAY, MINUTE, NOW

from .registry import Tables, query

SUB = "submissions"
FIRST_USE = f"""
WITH RECURSIVE r AS (SELECT id, ts, tenant_id, idempotency_key AS k, sha256(body) AS h, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY ts, id) AS n FROM submissions WHERE idempotency_key IS NOT NULL),
walk AS (SELECT id, tenant_id, k, n, id AS owner, h, ts + {DAY} AS until, 'created' AS outcome FROM r WHERE n = 1
    UNION ALL SELECT r.id, r.tenant_id, r.k, r.n, CASE WHEN r.ts >= w.until THEN r.id ELSE w.owner END, CASE WHEN r.ts >= w.until THEN r.h ELSE w.h END, CASE WHEN r.ts >= w.until THEN r.ts + {DAY} ELSE w.until END,
        CASE WHEN r.ts >= w.until THEN 'created' WHEN r.h = w.h THEN 'replayed' ELSE 'key_reused' END
    FROM walk w JOIN r ON r.tenant_id = w.tenant_id AND r.k = w.k AND r.n = w.n + 1)
"""


@query(FIRST_USE + "SELECT tenant_id, k AS idempotency_key, id, owner, outcome FROM walk", SUB)
def submit_idempotent(t: Tables) -> DataFrame:
    return admission.first_use(t.submissions)


@query(
    """WITH held AS (SELECT tenant_id, team AS dedupe_key, min(id) AS held_by FROM jobs WHERE team IS NOT NULL GROUP BY ALL),
    keyed AS (SELECT s.id, coalesce(h.held_by, first_value(s.id) OVER (PARTITION BY s.tenant_id, s.dedupe_key ORDER BY s.ts, s.id)) AS job_id FROM submissions s LEFT JOIN held h ON h.tenant_id = s.tenant_id AND h.dedupe_key = s.dedupe_key WHERE s.dedupe_key IS NOT NULL)
    SELECT id, job_id, CASE WHEN id = job_id THEN 'created' ELSE 'deduplicated' END AS outcome FROM keyed UNION ALL SELECT id, id, 'created' FROM submissions WHERE dedupe_key IS NULL""",
    "submissions jobs",
)
def submit_deduplicated(t: Tables) -> DataFrame:
    return admission.deduplicate(t.submissions, t.jobs.withColumn("dedupe_key", F.col("team")))


@query(
    """SELECT t.id AS tenant_id, coalesce(t.max_pending, 1000) AS quota, least((SELECT count(*) FROM jobs j WHERE j.tenant_id = t.id AND j.state IN ('SCHEDULED', 'READY', 'RETRY_PENDING')), coalesce(t.max_pending, 1000)) AS pending,
    (SELECT count(*) FROM jobs j WHERE j.tenant_id = t.id AND j.state IN ('SCHEDULED', 'READY', 'RETRY_PENDING')) < coalesce(t.max_pending, 1000) AS allowed FROM tenants t""",
    "tenants jobs",
)
def pending_quota(t: Tables) -> DataFrame:
    return admission.pending_quota(t.jobs, t.tenants, 1000)


@query(
    """SELECT t.id AS tenant_id, coalesce(t.max_schedules, 100) AS quota, count(s.id) AS used, count(s.id) < coalesce(t.max_schedules, 100) AS allowed
    FROM tenants t LEFT JOIN schedules s ON s.tenant_id = t.id AND s.state IN ('ACTIVE', 'PAUSED') GROUP BY t.id, t.max_schedules""",
    "tenants schedules",
)
def schedule_quota(t: Tables) -> DataFrame:
    return admission.schedule_quota(t.schedules, t.tenants, 100)


@query(
    f"""WITH oldest AS (SELECT pool, ({NOW} - min(run_at)) / 1000 AS age_ms, count(*) % 2 = 0 AS fresh FROM jobs WHERE state = 'READY' GROUP BY ALL)
    SELECT j.pool, j.priority, count(*) AS n, bool_or(CASE WHEN o.fresh AND j.priority = 1 THEN o.age_ms > coalesce(p.backlog_target_ms, 200000000000) WHEN o.fresh AND j.priority = 2 THEN o.age_ms > 3 * coalesce(p.backlog_target_ms, 200000000000) ELSE false END) AS refused
    FROM jobs j JOIN pools p ON p.name = j.pool LEFT JOIN oldest o ON o.pool = j.pool GROUP BY ALL""",
    "jobs pools",
)
def shed_load(t: Tables) -> DataFrame:
    """Who would be refused, from each pool's oldest ready job and its target (or the default one)."""
    oldest = t.jobs.where("state = 'READY'").groupBy("pool").agg(((F.lit(NOW) - F.min("run_at")) / 1000).alias("age_ms"), (F.count("*") % 2 == 0).alias("fresh"))
    classes = t.jobs.groupBy("pool", "priority").agg(F.count("*").alias("n"))
    p = t.pools.select(F.col("name").alias("pool"), F.coalesce("backlog_target_ms", F.lit(200_000_000_000)).alias("target"))
    all_ = classes.join(p, "pool").join(oldest, "pool", "left")
    return all_.select("pool", "priority", "n", admission.shed(F.col("priority"), F.col("age_ms"), F.col("target"), F.coalesce("fresh", F.lit(False))).alias("refused"))


@query(
    """WITH RECURSIVE r AS (SELECT s.id, s.ts, s.tenant_id, 1.0 / 43200.0 * (1 + s.tenant_id % 3) AS rate, row_number() OVER (PARTITION BY s.tenant_id ORDER BY s.ts, s.id) AS n FROM submissions s),
    b AS (SELECT id, ts, tenant_id, rate, n, 86400.0 * rate AS had FROM r WHERE n = 1
        UNION ALL SELECT r.id, r.ts, r.tenant_id, r.rate, r.n, least(86400.0 * r.rate, CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END + CAST(r.ts - b.ts AS DOUBLE) / 1000000.0 * r.rate) FROM b JOIN r ON r.tenant_id = b.tenant_id AND r.n = b.n + 1)
    SELECT tenant_id, count(*) AS asked, count(*) FILTER (WHERE had >= 1) AS allowed FROM b GROUP BY ALL""",
    SUB,
)
def token_bucket(t: Tables) -> DataFrame:
    """Requests that a bucket lets pass; the rate is a few a day, as the events are sparse."""
    rows = t.submissions.withColumn("rate", F.lit(1.0) / 43200.0 * (1 + F.col("tenant_id") % 3))
    out = admission.token_bucket(rows.select("tenant_id", "ts", "id", "rate"), "tenant_id", "rate", burst=86400.0)
    return out.groupBy("tenant_id").agg(F.count("*").alias("asked"), F.count_if("allowed").alias("allowed"))


#: What submissions of every kind ask for: their own values, none, and wrong ones.
ASKED = f"""asked AS (SELECT id, tenant_id, id % 5 AS job_type, CASE id % 7 WHEN 0 THEN 'urgent' WHEN 1 THEN 'critical' WHEN 2 THEN 'Low' WHEN 3 THEN '' END AS priority,
    CASE id % 11 WHEN 0 THEN '90s' WHEN 1 THEN '25h' WHEN 2 THEN '10ms' WHEN 3 THEN 'soon' WHEN 4 THEN '24h' END AS attempt_timeout, CASE id % 13 WHEN 0 THEN '10m' WHEN 1 THEN '-1s' WHEN 2 THEN '1h' END AS delay,
    CASE WHEN id % 26 IN (2, 5) THEN {NOW + DAY} END AS run_at, CASE WHEN tenant_id % 2 = 0 THEN 'submitter' ELSE 'admin' END AS role FROM submissions)"""


@query(
    f"""WITH {ASKED}, j AS (SELECT a.*, y.enabled, y.attempt_timeout_ms, CASE WHEN coalesce(a.priority, '') = '' THEN y.default_priority ELSE CASE upper(a.priority) WHEN 'LOW' THEN 1 WHEN 'NORMAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END END AS p FROM asked a LEFT JOIN job_types y ON y.tenant_id = a.tenant_id AND y.name = a.job_type)
    SELECT id, p AS priority, CASE attempt_timeout WHEN '90s' THEN 90000000 WHEN '25h' THEN 90000000000 WHEN '10ms' THEN 10000 WHEN 'soon' THEN NULL WHEN '24h' THEN 86400000000 ELSE attempt_timeout_ms * 1000 END AS timeout,
    coalesce(CASE delay WHEN '10m' THEN {NOW} + 600000000 WHEN '-1s' THEN {NOW} - 1000000 WHEN '1h' THEN {NOW} + 3600000000 ELSE run_at END, {NOW}) AS run_at,
    CASE WHEN delay IS NOT NULL AND run_at IS NOT NULL OR delay = '-1s' THEN 'delay' WHEN enabled IS NULL OR NOT enabled THEN 'type' WHEN priority <> '' AND p IS NULL THEN 'priority' WHEN attempt_timeout IN ('25h', '10ms', 'soon') THEN 'attempt_timeout'
        WHEN p = 4 AND role = 'submitter' THEN 'critical needs operator' END AS rejected FROM j""",
    "submissions job_types",
)
def resolve_submission(t: Tables) -> DataFrame:
    """A type's defaults under a request's own values; the first reason against it."""
    c = F.expr
    asked = t.submissions.select(
        "id",
        "tenant_id",
        c("cast(id % 5 as int)").alias("job_type"),
        c("case id % 7 when 0 then 'urgent' when 1 then 'critical' when 2 then 'Low' when 3 then '' end").alias("priority"),
        c("case id % 11 when 0 then '90s' when 1 then '25h' when 2 then '10ms' when 3 then 'soon' when 4 then '24h' end").alias("attempt_timeout"),
        c("case id % 13 when 0 then '10m' when 1 then '-1s' when 2 then '1h' end").alias("delay"),
        F.when(c("id % 26 in (2, 5)"), F.lit(NOW + DAY)).alias("run_at"),
        c("case when tenant_id % 2 = 0 then 'submitter' else 'admin' end").alias("role"),
    )
    return admission.resolve(asked, t.job_types, NOW)


@query(
    """WITH RECURSIVE r AS (SELECT s.id, s.ts, s.tenant_id, coalesce(y.rate_limit, 3.0) / 86400.0 * CASE WHEN s.tenant_id % 10 = 9 THEN 0 ELSE 1 END AS rate, row_number() OVER (PARTITION BY s.tenant_id ORDER BY s.ts, s.id) AS n FROM submissions s JOIN tenants y ON y.id = s.tenant_id),
    b AS (SELECT id, ts, tenant_id, rate, n, 86400.0 * rate AS had FROM r WHERE n = 1
        UNION ALL SELECT r.id, r.ts, r.tenant_id, r.rate, r.n, least(86400.0 * r.rate, CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END + CAST(r.ts - b.ts AS DOUBLE) / 1000000.0 * r.rate) FROM b JOIN r ON r.tenant_id = b.tenant_id AND r.n = b.n + 1)
    SELECT tenant_id, count(*) AS asked, count(*) FILTER (WHERE had >= 1) AS allowed FROM b GROUP BY ALL""",
    "submissions tenants",
)
def tenant_rates(t: Tables) -> DataFrame:
    """Each tenant's own limit (a day, as events are sparse), the default where it has none, and 0, which lets nothing pass."""
    limits = t.tenants.select(F.col("id").alias("tenant_id"), (F.col("rate_limit") / 86400.0).alias("limit"))
    rows = t.submissions.join(limits, "tenant_id").withColumn("rate", F.when(F.col("tenant_id") % 10 == 9, 0.0).otherwise(F.col("limit")))
    out = admission.token_bucket(rows.select("tenant_id", "ts", "id", "rate"), "tenant_id", "rate", burst=86400.0, default=3.0 / 86400.0)
    return out.groupBy("tenant_id").agg(F.count("*").alias("asked"), F.count_if("allowed").alias("allowed"))


@query(
    """SELECT id, lower(name) AS name, regexp_matches(name, '^[a-z0-9][a-z0-9._-]{0,99}$') AS name_ok, CASE priority WHEN 'LOW' THEN 1 WHEN 'NORMAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END AS priority,
    (array_position(['viewer', 'submitter', 'operator', 'admin', 'platform-admin'], role) >= 3) AS may_operate
    FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'job-' || id WHEN id % 3 = 1 THEN 'Bad Name' ELSE name END AS name, upper(CASE id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'Normal' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'critical' ELSE 'urgent' END) AS priority,
        CASE id % 5 WHEN 0 THEN 'viewer' WHEN 1 THEN 'submitter' WHEN 2 THEN 'operator' WHEN 3 THEN 'admin' ELSE 'platform-admin' END AS role FROM tenants)""",
    "tenants",
)
def field_rules(t: Tables) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("id") % 5 + 1).cast("int"))
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("job-"), "id")).when(F.col("id") % 3 == 1, "Bad Name").otherwise(F.col("name"))
    role = pick(admission.ROLES)
    return t.tenants.select("id", F.lower(name).alias("name"), name.rlike(admission.NAME).alias("name_ok"), admission.priority_number(pick(("low", "Normal", "HIGH", "critical", "urgent"))).alias("priority"), admission.includes(role, F.lit("operator")).alias("may_operate"))


@query(
    """SELECT id, sha256(body) AS hash, CAST(id % 100 * 3600000000 + id % 60 * 60000000 + id % 7 * 1000000 AS BIGINT) AS micros, (id % 100) || 'h' || (id % 60) || 'm' || (id % 7) || 's' AS written FROM submissions""",
    SUB,
)
def durations(t: Tables) -> DataFrame:
    written = F.concat((F.col("id") % 100).cast("string"), F.lit("h"), (F.col("id") % 60).cast("string"), F.lit("m"), (F.col("id") % 7).cast("string"), F.lit("s"))
    return t.submissions.select("id", F.sha2(F.col("body"), 256).alias("hash"), text.duration_micros(written).alias("micros"), written.alias("written"))


@query("SELECT pool, array_to_string(list_sort(list_distinct(list(job_type))), ',') AS types, count(*) AS n FROM (SELECT pool, CAST(job_type AS VARCHAR) AS job_type, tenant_id FROM jobs) GROUP BY pool", "jobs")
def type_sets(t: Tables) -> DataFrame:
    """The set of job types of a pool as one key; at most as many as there are types."""
    return t.jobs.groupBy("pool").agg(text.set_key(F.collect_set(F.col("job_type").cast("string")), ",").alias("types"), F.count("*").alias("n"))


NOISE = "concat(length(CAST(created_at AS VARCHAR)), ':', created_at, length(CAST(id AS VARCHAR)), ':', id, length(pool), ':', pool)"


@query(
    f"""WITH h AS (SELECT id, sha256({NOISE}) AS n, lpad(lower(to_hex(created_at // 1000)), 12, '0') AS ms FROM all_jobs)
    SELECT id, concat(left(ms, 8), '-', ms[9:12], '-7', left(n, 3), '-', ('89ab')[1 + (strpos('0123456789abcdef', n[4]) - 1) % 4], n[5:7], '-', n[8:19]) AS uuid FROM h""",
    "all_jobs",
)
def job_uuids(t: Tables) -> DataFrame:
    """Ids for all jobs that sort by creation and are the same at every run."""
    return t.all_jobs.select("id", ids.uuid7(F.col("created_at"), F.col("id"), F.col("pool")).alias("uuid"))


@query()
def cached_quotas(t: Tables) -> DataFrame:
    """What submissions see of a quota that changes daily through a cache of half an hour; held against a walk in the tests."""
    reads = t.submissions.select(F.col("tenant_id").cast("string").alias("key"), "ts", "id")
    days = t.submissions.select(F.col("tenant_id").cast("string").alias("key"), F.expr(f"ts div {DAY} * {DAY}").alias("at")).distinct()
    return admission.through_cache(reads, days.withColumn("value", F.expr(f"at div {DAY}")), 30 * MINUTE)
