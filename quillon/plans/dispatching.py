"""Queries about claiming, completing, releasing and recovering jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators import dispatch, rounds, states
from quillon.sources.views import DAY, MINUTE, NOW, SECOND

from .registry import Tables, query

CLAIMABLE = f"state = 'READY' AND (start_deadline IS NULL OR start_deadline > {NOW} OR attempt_count > 0)"
NOT_HELD = "NOT EXISTS (SELECT 1 FROM job_types t WHERE t.paused AND t.tenant_id = j.tenant_id AND t.name = j.job_type) AND NOT EXISTS (SELECT 1 FROM pools p WHERE p.paused AND p.name = j.pool)"
#: What may be claimed, with tenants at their cap left out before candidates are taken.
ELIGIBLE = f"""running AS (SELECT pool, tenant_id, count(*) AS n FROM jobs WHERE state = 'RUNNING' GROUP BY ALL),
eligible AS (SELECT j.*, t.max_running - coalesce(r.n, 0) AS allowance FROM jobs j LEFT JOIN tenants t ON t.id = j.tenant_id LEFT JOIN running r ON r.pool = j.pool AND r.tenant_id = j.tenant_id
    WHERE {CLAIMABLE} AND {NOT_HELD} AND (t.max_running IS NULL OR t.max_running > coalesce(r.n, 0)))"""
CLAIM = f"""WITH {ELIGIBLE},
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool, priority ORDER BY run_at, id) AS c FROM eligible {{where}}) WHERE c <= 40),
fair AS (SELECT *, row_number() OVER (PARTITION BY pool, priority, tenant_id ORDER BY run_at, id) AS nth FROM candidates),
picked AS (SELECT *, row_number() OVER (PARTITION BY pool, priority ORDER BY run_at, id) AS rank FROM fair WHERE allowance IS NULL OR nth <= allowance)
SELECT p.id, p.pool, p.priority, p.tenant_id, p.rank, p.attempt_count + 1 AS attempt, {NOW} + y.attempt_timeout_ms * 1000 AS deadline
FROM picked p LEFT JOIN job_types y ON y.tenant_id = p.tenant_id AND y.name = p.job_type WHERE p.rank <= 10"""


@query(CLAIM.format(where=""), "jobs tenants job_types pools")
def claim_batch(t: Tables) -> DataFrame:
    return dispatch.claim(t.jobs, t.tenants, t.job_types, t.pools, NOW, 10)


#: Leases as their holders know them: one has been taken over since, one names no pool.
KNOWN = "SELECT name, holder, epoch - CASE WHEN holder = 'ASIA' THEN 1 ELSE 0 END AS epoch FROM leases"


@query(CLAIM.format(where=f"WHERE job_type IN (0, 2) AND EXISTS (SELECT 1 FROM leases l JOIN ({KNOWN}) k ON k.name = l.name AND k.holder = l.holder AND k.epoch = l.epoch WHERE l.name = 'pool:' || pool)"), "jobs tenants job_types pools leases")
def claim_fenced(t: Tables) -> DataFrame:
    """A claim by workers that take two of the job types, for the pools whose lease still is as its holder knows it."""
    known = t.leases.select("name", "holder", (F.col("epoch") - F.when(F.col("holder") == "ASIA", 1).otherwise(0)).alias("epoch"))
    return dispatch.claim(dispatch.fenced(t.jobs, known, t.leases), t.tenants, t.job_types, t.pools, NOW, 10, [0, 2])


def _round_sql() -> str:
    """Class by class: what more urgent classes have got counts as running."""
    parts, got = [], ["SELECT pool, tenant_id FROM jobs WHERE state = 'RUNNING'"]
    for p in (4, 3, 2, 1):
        parts.append(f"""h{p} AS (SELECT pool, tenant_id, count(*) AS n FROM ({" UNION ALL ".join(got)}) GROUP BY ALL),
c{p} AS (SELECT * FROM (SELECT j.id, j.pool, j.priority, j.tenant_id, j.run_at, t.max_running - coalesce(h.n, 0) AS allowance, row_number() OVER (PARTITION BY j.pool ORDER BY j.run_at, j.id) AS c FROM jobs j LEFT JOIN tenants t ON t.id = j.tenant_id
    LEFT JOIN h{p} h ON h.pool = j.pool AND h.tenant_id = j.tenant_id WHERE j.priority = {p} AND {CLAIMABLE} AND {NOT_HELD} AND (t.max_running IS NULL OR t.max_running > coalesce(h.n, 0))) WHERE c <= 40),
p{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY run_at, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pool, tenant_id ORDER BY run_at, id) AS nth FROM c{p}) WHERE allowance IS NULL OR nth <= allowance) WHERE rank <= 10)""")
        got.append(f"SELECT pool, tenant_id FROM p{p}")
    return "WITH " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT id, pool, priority, tenant_id, rank FROM p{p}" for p in (4, 3, 2, 1))


@query(_round_sql(), "jobs tenants job_types pools")
def claim_round(t: Tables) -> DataFrame:
    return rounds.claim_round(t.jobs, t.tenants, t.job_types, t.pools, NOW, 10)


@query("SELECT DISTINCT j.pool, j.priority FROM jobs j WHERE " + CLAIMABLE + " AND " + NOT_HELD, "jobs job_types pools")
def ready_priorities(t: Tables) -> DataFrame:
    """Priorities of each pool that have work: an existence test for four values, so a semi join from them."""
    ready = dispatch.not_held(t.jobs.where(dispatch.claimable(NOW)), t.job_types, t.pools).select("pool", "priority")
    classes = t.pools.select(F.col("name").alias("pool"), F.explode(F.array(*(F.lit(p) for p in (1, 2, 3, 4)))).alias("priority"))
    return classes.join(ready, ["pool", "priority"], "left_semi")


@query(
    """SELECT id, 'READY' AS state, attempt_count, greatest(0, attempt_count - 1) AS budget_attempts, CASE WHEN attempt_count <> 1 THEN attempt_started_at END AS budget_started_at
    FROM jobs WHERE state = 'RUNNING' AND (id, attempt_count) IN (SELECT job_id, CAST(number AS INT) FROM attempts)""",
    "jobs attempts",
)
def release_attempts(t: Tables) -> DataFrame:
    return dispatch.release(t.jobs, t.attempts.select(F.col("job_id").alias("id"), F.col("number").cast("int").alias("attempt")))


REPORTS = """reports AS (SELECT j.id AS job_id, CAST(CASE WHEN j.id % 6 = 5 THEN j.attempt_count + 1 ELSE j.attempt_count END AS INT) AS attempt,
    CASE j.id % 5 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'TIMED_OUT' WHEN 3 THEN 'LOST' ELSE 'CANCELLED' END AS outcome, j.id % 4 <> 0 AS retryable FROM all_jobs j)"""


def _reports(t: Tables) -> DataFrame:
    j = t.all_jobs
    outcome = F.element_at(F.array(*(F.lit(s) for s in ("SUCCEEDED", "FAILED", "TIMED_OUT", "LOST", "CANCELLED"))), (F.col("id") % 5 + 1).cast("int"))
    return j.select(F.col("id").alias("job_id"), F.when(F.col("id") % 6 == 5, F.col("attempt_count") + 1).otherwise(F.col("attempt_count")).cast("int").alias("attempt"), outcome.alias("outcome"), (F.col("id") % 4 != 0).alias("retryable"))


def decide_sql(end: str, retryable: str, attempts: str, lost: str) -> str:
    """The retry rules as CASE expressions over a running job's columns: next, reason, run_at."""
    delay = f"least(10000.0 * pow(2.0, greatest({attempts}, 1) - 1), 3600000.0)"
    run_at = f"{NOW} + CAST({delay} AS BIGINT) * 1000"
    last = "least(attempt_started_at + 86400000000, coalesce(deadline, attempt_started_at + 86400000000))"
    rules = [
        (f"{end} = 'SUCCEEDED'", "SUCCEEDED", None),
        (f"cancel_requested_at IS NOT NULL OR {end} = 'CANCELLED'", "CANCELLED", "CANCELLED"),
        (f"{end} = 'FAILED' AND NOT {retryable}", "FAILED", "NON_RETRYABLE"),
        (f"at_most_once AND {end} = 'FAILED'", "FAILED", "AT_MOST_ONCE"),
        ("at_most_once", "FAILED", "OUTCOME_UNKNOWN"),
        (f"{end} = 'LOST' AND {lost} >= 3", "DEAD_LETTERED", "POISON"),
        (f"{attempts} >= 10", "DEAD_LETTERED", "ATTEMPTS_EXHAUSTED"),
        (f"{run_at} > {last}", "DEAD_LETTERED", "DEADLINE_EXCEEDED"),
    ]
    case = lambda pick, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {pick(r)}" for r in rules) + f" ELSE {other} END"
    text = lambda s: f"'{s}'" if s else "NULL"
    return f"{case(lambda r: text(r[1]), text('RETRY_PENDING'))} AS next, {case(lambda r: text(r[2]), f'''CASE {end} WHEN 'FAILED' THEN 'RETRYABLE_ERROR' ELSE {end} END''')} AS reason, {case(lambda r: 'NULL', run_at)} AS run_at"


@query(
    f"""WITH {REPORTS}, joined AS (SELECT r.*, j.id, j.attempt_count, j.budget_lost, j.at_most_once, j.cancel_requested_at, j.attempt_started_at, j.deadline, a.state AS recorded
        FROM reports r LEFT JOIN jobs j ON j.id = r.job_id AND j.attempt_count = r.attempt AND j.state = 'RUNNING' LEFT JOIN attempts a ON a.job_id = r.job_id AND a.number = r.attempt),
    decided AS (SELECT *, {decide_sql("outcome", "retryable", "attempt_count", "(budget_lost + CAST(outcome = 'LOST' AS INT))")} FROM joined)
    SELECT job_id, attempt, CASE WHEN id IS NOT NULL THEN 'applied' WHEN recorded = outcome THEN 'replay' ELSE 'stale' END AS status,
    CASE WHEN id IS NOT NULL THEN next END AS next, CASE WHEN id IS NOT NULL THEN reason END AS reason, CASE WHEN id IS NOT NULL THEN run_at END AS run_at FROM decided""",
    "all_jobs jobs attempts",
)
def complete_attempts(t: Tables) -> DataFrame:
    return dispatch.complete(t.jobs, _reports(t), t.attempts, NOW)


@query(
    f"""SELECT s.id, s.pool, s.lease_expires_at FROM worker_sessions s LEFT JOIN engine_nodes n ON n.node_id = s.renewed_by
    WHERE s.state = 'ACTIVE' AND s.lease_expires_at < {NOW} AND (s.renewed_by IS NULL OR n.stopped_at IS NOT NULL OR n.beat_at > s.lease_expires_at OR s.lease_expires_at < {NOW} - {60 * MINUTE})""",
    "worker_sessions engine_nodes",
)
def expire_sessions(t: Tables) -> DataFrame:
    return dispatch.expired_sessions(t.worker_sessions, t.engine_nodes, NOW, 60 * MINUTE)


@query(
    f"""WITH held AS (SELECT j.* FROM jobs j JOIN worker_sessions s ON s.id = j.session_id WHERE j.state = 'RUNNING' AND s.state <> 'ACTIVE')
    SELECT id, {decide_sql("'LOST'", "true", "attempt_count", "(budget_lost + 1)")} FROM held""",
    "jobs worker_sessions",
)
def lose_orphans(t: Tables) -> DataFrame:
    return dispatch.end_attempts(dispatch.orphans(t.jobs, t.worker_sessions), "LOST", NOW)


@query(
    f"""WITH late AS (SELECT * FROM jobs WHERE state = 'RUNNING' AND attempt_deadline < {NOW - 30 * SECOND})
    SELECT id, {decide_sql("'TIMED_OUT'", "true", "attempt_count", "budget_lost")} FROM late""",
    "jobs",
)
def time_out_overdue(t: Tables) -> DataFrame:
    return dispatch.end_attempts(t.jobs.where(dispatch.overdue_attempt(NOW)), "TIMED_OUT", NOW)


@query(
    f"""WITH running AS (SELECT id AS job_id, attempt_count AS attempt, session_id, cancel_requested_at, attempt_started_at, job_type, pool FROM jobs WHERE state = 'RUNNING'),
    reported AS (SELECT session_id, job_id, CAST(CASE WHEN job_id % 10 = 0 THEN attempt + 1 ELSE attempt END AS INT) AS attempt FROM running WHERE job_type <> 3 AND pool <> 'BUILDING')
    SELECT *, 'stale' AS verdict FROM reported r WHERE NOT EXISTS (SELECT 1 FROM running x WHERE x.session_id = r.session_id AND x.job_id = r.job_id AND x.attempt = r.attempt)
    UNION ALL SELECT session_id, job_id, attempt, 'release' FROM running x WHERE attempt_started_at < {NOW - 15 * SECOND} AND session_id IN (SELECT session_id FROM reported)
        AND NOT EXISTS (SELECT 1 FROM reported r WHERE x.session_id = r.session_id AND x.job_id = r.job_id AND x.attempt = r.attempt)
    UNION ALL SELECT session_id, job_id, attempt, 'cancel' FROM running x WHERE cancel_requested_at IS NOT NULL AND session_id IN (SELECT session_id FROM reported)""",
    "jobs",
)
def heartbeat_reconcile(t: Tables) -> DataFrame:
    running = t.jobs.where("state = 'RUNNING' and job_type <> 3 and pool <> 'BUILDING'")  # what workers report, in this case
    reported = running.select("session_id", F.col("id").alias("job_id"), F.when(F.col("id") % 10 == 0, F.col("attempt_count") + 1).otherwise(F.col("attempt_count")).cast("int").alias("attempt"))
    return dispatch.heartbeat(reported, t.jobs, NOW)


@query(
    """WITH ranked AS (SELECT id, pool, priority, run_at, row_number() OVER (PARTITION BY pool, priority ORDER BY run_at, id) AS nth FROM jobs WHERE state = 'READY'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY (nth - 0.5) / CASE priority WHEN 4 THEN 8 WHEN 3 THEN 4 WHEN 2 THEN 2 ELSE 1 END, priority DESC, run_at, id) AS turn FROM ranked)
    SELECT id, pool, priority, turn FROM placed WHERE turn <= 60""",
    "jobs",
)
def weighted_order(t: Tables) -> DataFrame:
    """The first sixty of each pool's queue in weighted round-robin order (a dispatch round's size)."""
    few = dispatch.first_of_each(t.jobs.where("state = 'READY'"), ["pool", "priority"], [F.col("run_at"), F.col("id")], 60)
    return dispatch.interleave(few, ["pool"], [F.col("run_at"), F.col("id")]).where("turn <= 60").select("id", "pool", "priority", "turn")


@query(
    """WITH steps AS (SELECT job_id, number, state, lag(state) OVER (PARTITION BY job_id ORDER BY number) AS last FROM attempts),
    moves AS (SELECT coalesce(last, '') AS from_state, state AS to_state, count(*) AS n FROM steps GROUP BY ALL)
    SELECT from_state, to_state, n, to_state IN ('SUCCEEDED', 'FAILED', 'CANCELLED', 'TIMED_OUT', 'LOST') AS terminal, from_state IN ('TIMED_OUT', 'LOST', 'FAILED', '') AS may_follow FROM moves""",
    "attempts",
)
def attempt_moves(t: Tables) -> DataFrame:
    """How attempts of a job follow each other; after an outcome that ends the job none should."""
    w = Window.partitionBy("job_id").orderBy("number")
    moves = t.attempts.select(F.coalesce(F.lag("state").over(w), F.lit("")).alias("from_state"), F.col("state").alias("to_state")).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return moves.withColumn("terminal", F.col("to_state").isin(*states.ATTEMPT_ENDS)).withColumn("may_follow", F.col("from_state").isin("TIMED_OUT", "LOST", "FAILED", ""))


@query(
    f"""WITH edges(from_state, to_state, actor) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in states.JOB_EDGES)}),
    asked AS (SELECT id, state AS from_state, CASE id % 6 WHEN 0 THEN 'READY' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN 'PAUSED' WHEN 4 THEN 'SUCCEEDED' ELSE 'EXPIRED' END AS to_state,
        CASE id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'promoter' ELSE 'dispatcher' END AS actor FROM all_jobs)
    SELECT from_state, to_state, actor, count(*) AS n, (from_state, to_state, actor) IN (SELECT from_state, to_state, actor FROM edges) AS allowed FROM asked GROUP BY ALL""",
    "all_jobs",
)
def state_transitions(t: Tables) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("id") % n + 1).cast("int"))
    asked = t.all_jobs.select(F.col("state").alias("from_state"), pick(("READY", "RUNNING", "CANCELLED", "PAUSED", "SUCCEEDED", "EXPIRED"), 6).alias("to_state"), pick(("api", "promoter", "dispatcher"), 3).alias("actor"))
    return states.check(asked.groupBy("from_state", "to_state", "actor").agg(F.count("*").alias("n")))


@query(
    f"""WITH acted AS (SELECT *, CASE id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'pause' WHEN 2 THEN 'run_now' ELSE 'retry' END AS action FROM all_jobs)
    SELECT id, action, CASE
        WHEN action = 'cancel' AND state IN ('SCHEDULED', 'READY', 'PAUSED', 'RETRY_PENDING') THEN 'CANCELLED'
        WHEN action = 'cancel' AND state = 'RUNNING' AND cancel_requested_at IS NULL THEN 'REQUESTED'
        WHEN action = 'cancel' AND (state = 'CANCELLED' OR state = 'RUNNING') THEN 'UNCHANGED'
        WHEN action = 'pause' AND state IN ('SCHEDULED', 'READY') THEN 'PAUSED'
        WHEN action = 'run_now' AND state IN ('SCHEDULED', 'RETRY_PENDING') THEN 'DUE_NOW'
        WHEN action = 'retry' AND state IN ('FAILED', 'DEAD_LETTERED') THEN 'READY' ELSE 'CONFLICT' END AS result,
    CASE WHEN action = 'run_now' AND state IN ('SCHEDULED', 'RETRY_PENDING') THEN {NOW} ELSE run_at END AS run_at FROM acted""",
    "all_jobs",
)
def lifecycle_actions(t: Tables) -> DataFrame:
    action = F.element_at(F.array(*(F.lit(a) for a in ("cancel", "pause", "run_now", "retry"))), (F.col("id") % 4 + 1).cast("int"))
    return states.lifecycle(t.all_jobs.withColumn("action", action), NOW).select("id", "action", "result", "run_at")


@query(
    f"""SELECT CASE WHEN NOT (({CLAIMABLE}) AND {NOT_HELD}) THEN 'not claimable' ELSE 'claimable' END AS verdict,
    state = 'READY' AND attempt_count = 0 AND coalesce(start_deadline <= {NOW}, false) AS overdue, count(*) AS n FROM jobs j WHERE run_at <= {NOW + DAY} GROUP BY ALL""",
    "jobs job_types pools",
)
def claimable_counts(t: Tables) -> DataFrame:
    soon = t.jobs.where(F.col("run_at") <= NOW + DAY)
    good = dispatch.not_held(soon.where(dispatch.claimable(NOW)), t.job_types, t.pools).select("id").distinct().withColumn("good", F.lit(True))
    marked = soon.join(good, "id", "left").select(F.when(F.col("good"), "claimable").otherwise("not claimable").alias("verdict"), F.coalesce((F.col("state") == "READY") & (F.col("attempt_count") == 0) & F.coalesce(F.col("start_deadline") <= NOW, F.lit(False)), F.lit(False)).alias("overdue"))
    return marked.groupBy("verdict", "overdue").agg(F.count("*").alias("n"))
