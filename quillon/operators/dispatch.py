"""Claiming, releasing, completing and recovering jobs, as set operations.

Every operator takes the time ``now`` (microseconds since the epoch) as a
parameter and returns decisions: a row for each row it touches, with the new
column values. Nothing is mutated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import lists

SECOND = 1_000_000
#: States.
ACTIVE = ("SCHEDULED", "READY", "RUNNING", "RETRY_PENDING")
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED", "EXPIRED", "SKIPPED", "DEAD_LETTERED")
#: The default retry policy; durations in milliseconds.
RETRY = {"strategy": "exponential", "initial_delay_ms": 10_000, "multiplier": 2.0, "max_delay_ms": 3_600_000, "max_attempts": 10, "max_retry_duration_ms": 86_400_000, "max_lost_attempts": 3}


# -- predicates ---------------------------------------------------------------


def claimable(now: int) -> Column:
    """Ready, and not past its start deadline unless it has been tried."""
    return (F.col("state") == "READY") & (F.col("start_deadline").isNull() | (F.col("start_deadline") > now) | (F.col("attempt_count") > 0))


def due(now: int) -> Column:
    """Waiting jobs whose time has come; runs of schedules are promoted by the overlap rules instead, but for retries."""
    return F.col("state").isin("SCHEDULED", "RETRY_PENDING") & (F.col("run_at") <= now) & (F.col("schedule_id").isNull() | (F.col("state") == "RETRY_PENDING"))


def overdue_start(now: int) -> Column:
    return F.col("state").isin("SCHEDULED", "READY") & (F.col("attempt_count") == 0) & (F.col("start_deadline") <= now)


def overdue_attempt(now: int, grace: int = 30 * SECOND) -> Column:
    return (F.col("state") == "RUNNING") & (F.col("attempt_deadline") < now - grace)


# -- claim ---------------------------------------------------------------------


def not_held(jobs: DataFrame, job_types: DataFrame, pools: DataFrame) -> DataFrame:
    """Without the jobs of paused types and paused pools."""
    paused = job_types.where("paused").select("tenant_id", F.col("name").alias("job_type"))
    stopped = pools.where("paused").select(F.col("name").alias("pool"))
    return jobs.join(paused, ["tenant_id", "job_type"], "left_anti").join(stopped, "pool", "left_anti")


def allowances(jobs: DataFrame, tenants: DataFrame) -> DataFrame:
    """(pool, tenant_id, allowance): how many more jobs a capped tenant may run in a pool."""
    running = jobs.where("state = 'RUNNING'").groupBy("pool", "tenant_id").agg(F.count("*").alias("running"))
    caps = tenants.where("max_running is not null").select(F.col("id").alias("tenant_id"), "max_running")
    each = caps.join(jobs.select("tenant_id", "pool").distinct(), "tenant_id")
    return each.join(running, ["pool", "tenant_id"], "left").select("pool", "tenant_id", F.greatest(F.lit(0), F.col("max_running") - F.coalesce("running", F.lit(0))).cast("long").alias("allowance"))


def cap_memory(memory: DataFrame, allowed: DataFrame, now: int) -> DataFrame:
    """(pool, tenant_id, at_cap, freed_at) carried on by a round's allowances: a tenant that was at its cap and has room again was freed now; tenants without a cap any more stay as they are."""
    both = memory.join(allowed, ["pool", "tenant_id"], "full_outer")
    room, known = F.col("allowance") > 0, F.col("allowance").isNotNull()
    at_cap = F.when(known, ~room).otherwise(F.col("at_cap"))
    freed = F.when(known & room & F.coalesce("at_cap", F.lit(False)), F.lit(now)).otherwise(F.col("freed_at"))
    return both.select("pool", "tenant_id", at_cap.alias("at_cap"), freed.cast("long").alias("freed_at"))


def first_of_each(df: DataFrame, by: list[str], order: list, most, name: str = "rank") -> DataFrame:
    """Rows ranked within a group, up to a rank. Spark keeps only ``most`` rows of a group in each task before it shuffles, so a hot group stays small."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(name) <= most).withColumn(name, F.col(name).cast("long"))


def fenced(jobs: DataFrame, claims: DataFrame, leases: DataFrame) -> DataFrame:
    """Jobs of the pools whose lease is held as claimed: claims (name, holder, epoch), a pool's lease is named ``pool:<name>``."""
    held = lists.holds_lease(claims, leases).where(F.col("name").startswith("pool:")).select(F.expr("substring(name, 6)").alias("pool"))
    return jobs.join(held, "pool", "left_semi")


def open_to_claims(jobs: DataFrame, tenants: DataFrame, job_types: DataFrame, pools: DataFrame, now: int, types: list[int] | None = None) -> DataFrame:
    """Claimable jobs that nothing holds, with their tenants' allowance (null: no cap). Tenants at their cap are left out, as are types that a worker does not take (none given: it takes any)."""
    ready = not_held(jobs.where(claimable(now)), job_types, pools)
    if types:
        ready = ready.where(F.col("job_type").isin(types))
    return ready.join(allowances(jobs, tenants), ["pool", "tenant_id"], "left").where("allowance is null or allowance > 0")


def reach(limit: int) -> int:
    """How many candidates a claim of so many jobs looks at, as some may be over their tenant's allowance. Where no tenant has one, the first ``limit`` are taken of them all the same."""
    return min(4 * limit, max(limit, 1000))


def claim(jobs: DataFrame, tenants: DataFrame, job_types: DataFrame, pools: DataFrame, now: int, limit: int, types: list[int] | None = None) -> DataFrame:
    """An independent claim of up to ``limit`` jobs for each pool and priority.

    Tenants at their cap are skipped. Of the others more candidates than asked for are taken
    in due order, then each tenant's allowance cuts, then the limit.
    """
    order = [F.col("run_at"), F.col("id")]
    candidates = first_of_each(open_to_claims(jobs, tenants, job_types, pools, now, types), ["pool", "priority"], order, reach(limit)).drop("rank")
    fair = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("pool", "priority", "tenant_id").orderBy(*order))).where("allowance is null or nth <= allowance")
    picked = first_of_each(fair, ["pool", "priority"], order, limit)
    kinds = job_types.select("tenant_id", F.col("name").alias("job_type"), "attempt_timeout_ms")
    return picked.join(kinds, ["tenant_id", "job_type"], "left").select("id", "pool", "priority", "tenant_id", "rank", (F.col("attempt_count") + 1).alias("attempt"), (F.lit(now) + F.col("attempt_timeout_ms") * 1000).alias("deadline"))


def release(jobs: DataFrame, refs: DataFrame) -> DataFrame:
    """Undelivered attempts go back: refs (id, attempt). The budget is refunded, the attempt count is kept."""
    held = jobs.where("state = 'RUNNING'").join(refs.select("id", F.col("attempt").alias("attempt_count")), ["id", "attempt_count"], "left_semi")
    return held.select("id", F.lit("READY").alias("state"), "attempt_count", F.greatest(F.lit(0), F.col("attempt_count") - 1).alias("budget_attempts"), F.when(F.col("attempt_count") != 1, F.col("attempt_started_at")).alias("budget_started_at"))


# -- the end of an attempt ----------------------------------------------------


def delays_us(policy: dict = RETRY) -> list[int]:
    """Delays after the 1st, 2nd, ... attempt in microseconds, up to the first that the cap holds. Each step cuts to whole nanoseconds, as a multiplier need not be whole."""
    cap = policy["max_delay_ms"] * 1_000_000
    d = policy["initial_delay_ms"] * 1_000_000
    out = [min(d, cap)]
    while policy["strategy"] == "exponential" and policy["multiplier"] > 1 and d < cap and len(out) < 10_000:
        d = int(float(d) * policy["multiplier"])
        out.append(min(d, cap))
    return [x // 1_000 for x in out]


def backoff_us(attempt: Column, policy: dict = RETRY) -> Column:
    """Delay before the attempt after ``attempt``, without jitter."""
    known = delays_us(policy)
    return F.element_at(F.array(*(F.lit(x).cast("long") for x in known)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(known))).cast("int"))


def retry_decision(end: Column, retryable: Column, attempts: Column, lost: Column, at_most_once: Column, cancelled: Column, started_at: Column, deadline: Column, now: Column, rnd: Column | None = None, retry_after_ms: Column | None = None, policy: dict = RETRY) -> Column:
    """What follows an ended attempt, as struct(next, reason, run_at); the first rule that holds decides."""
    delay = backoff_us(attempts, policy)
    if rnd is not None:
        delay = F.floor(delay * rnd).cast("long")
    if retry_after_ms is not None:
        delay = F.when((end == "FAILED") & (retry_after_ms > 0), F.least(retry_after_ms, F.lit(policy["max_delay_ms"])) * 1000).otherwise(delay)
    run_at = now + delay
    budget_end = started_at + policy["max_retry_duration_ms"] * 1000
    last = F.least(budget_end, deadline)  # least ignores nulls
    to = lambda state, reason=None, at=None: F.struct(F.lit(state).alias("next"), F.lit(reason).cast("string").alias("reason"), (at if at is not None else F.lit(None)).cast("long").alias("run_at"))
    why = F.when(end == "FAILED", "RETRYABLE_ERROR").otherwise(end)
    again = F.struct(F.lit("RETRY_PENDING").alias("next"), why.alias("reason"), run_at.cast("long").alias("run_at"))
    return (
        F.when(end == "SUCCEEDED", to("SUCCEEDED"))
        .when(cancelled | (end == "CANCELLED"), to("CANCELLED", "CANCELLED"))
        .when((end == "FAILED") & ~retryable, to("FAILED", "NON_RETRYABLE"))
        .when(at_most_once & (end == "FAILED"), to("FAILED", "AT_MOST_ONCE"))
        .when(at_most_once, to("FAILED", "OUTCOME_UNKNOWN"))
        .when((end == "LOST") & (lost >= policy["max_lost_attempts"]), to("DEAD_LETTERED", "POISON"))
        .when(attempts >= policy["max_attempts"], to("DEAD_LETTERED", "ATTEMPTS_EXHAUSTED"))
        .when(run_at > last, to("DEAD_LETTERED", "DEADLINE_EXCEEDED"))
        .otherwise(again)
    )


#: Limits of a retry policy; durations in milliseconds.
POLICY_LIMITS = {"max_attempts": 50, "min_delay_ms": 1_000, "max_delay_ms": 86_400_000, "max_retry_duration_ms": 604_800_000, "max_multiplier": 10.0}


def policy_violations(p: Column, limits: dict = POLICY_LIMITS) -> Column:
    """Every way in which a policy, a struct with the fields of RETRY and jitter, breaks the limits."""
    found = F.array(
        F.when(~p["strategy"].isin("fixed", "exponential"), "strategy"),
        F.when((p["strategy"] == "exponential") & ~p["multiplier"].between(1.0, limits["max_multiplier"]), "multiplier"),
        F.when(~p["jitter"].isin("none", "full"), "jitter"),
        F.when(p["initial_delay_ms"] < limits["min_delay_ms"], "initial_delay_ms"),
        F.when((p["max_delay_ms"] < p["initial_delay_ms"]) | (p["max_delay_ms"] > limits["max_delay_ms"]), "max_delay_ms"),
        F.when(~p["max_attempts"].between(1, limits["max_attempts"]), "max_attempts"),
        F.when((p["max_retry_duration_ms"] <= 0) | (p["max_retry_duration_ms"] > limits["max_retry_duration_ms"]), "max_retry_duration_ms"),
        F.when((p["max_lost_attempts"] < 1) | (p["max_lost_attempts"] > p["max_attempts"]), "max_lost_attempts"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def complete(jobs: DataFrame, reports: DataFrame, attempts: DataFrame, now: int) -> DataFrame:
    """reports (job_id, attempt, outcome, retryable), one a job. A report of the current attempt decides; one that repeats a recorded outcome is a replay; any other is stale."""
    current = jobs.where("state = 'RUNNING'")
    seen = attempts.select("job_id", F.col("number").alias("attempt"), F.col("state").alias("recorded"))
    r = reports.join(current, (reports["job_id"] == current["id"]) & (reports["attempt"] == current["attempt_count"]), "left")
    r = r.select(reports["*"], current["id"].isNotNull().alias("is_current"), "attempt_count", "budget_lost", "at_most_once", "cancel_requested_at", "attempt_started_at", "deadline")
    r = r.join(seen, ["job_id", "attempt"], "left")
    lost = F.col("budget_lost") + (F.col("outcome") == "LOST").cast("int")
    decision = retry_decision(F.col("outcome"), F.col("retryable"), F.col("attempt_count"), lost, F.col("at_most_once"), F.col("cancel_requested_at").isNotNull(), F.col("attempt_started_at"), F.col("deadline"), F.lit(now))
    status = F.when(F.col("is_current"), "applied").when(F.col("recorded") == F.col("outcome"), "replay").otherwise("stale")
    out = r.withColumn("status", status).withColumn("d", F.when(F.col("is_current"), decision))
    return out.select("job_id", "attempt", "status", F.col("d.next").alias("next"), F.col("d.reason").alias("reason"), F.col("d.run_at").alias("run_at"))


# -- recovery -----------------------------------------------------------------


def expired_sessions(sessions: DataFrame, nodes: DataFrame, now: int, tolerance: int) -> DataFrame:
    """Active sessions whose lease has passed, if that is the worker's doing: no engine renewed it, or that engine stopped, or was heard of after the lease's end, or the lease is older than the tolerance."""
    s = sessions.where((F.col("state") == "ACTIVE") & (F.col("lease_expires_at") < now))
    n = nodes.select(F.col("node_id").alias("renewed_by"), "beat_at", "stopped_at")
    told = F.col("renewed_by").isNull() | F.col("stopped_at").isNotNull() | (F.col("beat_at") > F.col("lease_expires_at")) | (F.col("lease_expires_at") < now - tolerance)
    return s.join(n, "renewed_by", "left").where(F.coalesce(told, F.lit(False))).select("id", "pool", "lease_expires_at")


def open_session(sessions: DataFrame, asked: DataFrame, now: int, ttl: int = 30 * SECOND) -> DataFrame:
    """New sessions (id, pool, worker_id, slots) beside the old ones, active until a lease from now; one whose id there is already changes nothing."""
    new = asked.join(sessions.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return sessions.unionByName(new.select("id", "pool", "worker_id", "slots", F.lit("ACTIVE").alias("state"), F.lit(now + ttl).alias("lease_expires_at"), F.lit(False).alias("draining")), allowMissingColumns=True)


def drain_sessions(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id): active sessions that take no more jobs; what they run goes on. Others are not touched."""
    return sessions.where((F.col("state") == "ACTIVE") & ~F.col("draining")).join(asked.select("id").distinct(), "id", "left_semi").select("id", F.lit(True).alias("draining"))


def close_sessions(sessions: DataFrame, asked: DataFrame, jobs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """asked (id): (active sessions that end, decisions for the attempts that they held, which are lost)."""
    ends = sessions.where("state = 'ACTIVE'").join(asked.select("id").distinct(), "id", "left_semi")
    held = jobs.where("state = 'RUNNING'").join(ends.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return ends.select("id", F.lit("CLOSED").alias("state"), F.lit(now).alias("closed_at")), end_attempts(held, "LOST", now)


def ended_attempts(jobs: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """The fact of each attempt that a report ends (job_id, attempt, outcome, retryable): a row of the attempts' table. Reports of other attempts than the current one make none."""
    held = jobs.where("state = 'RUNNING'").select(F.col("id").alias("job_id"), F.col("attempt_count").alias("attempt"), "tenant_id", "session_id", "attempt_started_at", "attempt_deadline")
    kept = F.when(F.col("outcome") == "FAILED", F.col("retryable"))
    return held.join(reports, ["job_id", "attempt"]).select("job_id", "tenant_id", F.col("attempt").cast("long").alias("number"), "session_id", F.col("outcome").alias("state"), kept.alias("retryable"), F.col("attempt_started_at").alias("started_at"), F.col("attempt_deadline").alias("deadline"), F.lit(now).alias("finished_at"))


def orphans(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Running jobs whose session is no longer active."""
    gone = sessions.where("state <> 'ACTIVE'").select(F.col("id").alias("session_id"), F.col("state").alias("session_state"))
    return jobs.where("state = 'RUNNING'").join(gone, "session_id")


def end_attempts(jobs: DataFrame, end: str, now: int) -> DataFrame:
    """Decisions for running jobs whose attempts end by ``end``."""
    lost = F.col("budget_lost") + int(end == "LOST")
    d = retry_decision(F.lit(end), F.lit(True), F.col("attempt_count"), lost, F.col("at_most_once"), F.col("cancel_requested_at").isNotNull(), F.col("attempt_started_at"), F.col("deadline"), F.lit(now))
    return jobs.withColumn("d", d).select("id", F.col("d.next").alias("next"), F.col("d.reason").alias("reason"), F.col("d.run_at").alias("run_at"))


def heartbeat(reported: DataFrame, jobs: DataFrame, now: int, quiet: int = 15 * SECOND) -> DataFrame:
    """reported (session_id, job_id, attempt). Reported attempts that aren't current are stale; running ones that a session does not report, started long enough ago, go back; cancel requests for what a session runs are passed on, reported or not."""
    running = jobs.where("state = 'RUNNING'").select(F.col("id").alias("job_id"), F.col("attempt_count").alias("attempt"), "session_id", "cancel_requested_at", "attempt_started_at")
    on = ["session_id", "job_id", "attempt"]
    stale = reported.join(running, on, "left_anti").select(*on, F.lit("stale").alias("verdict"))
    known = reported.select("session_id").distinct()
    silent = running.where(F.col("attempt_started_at") < now - quiet).join(known, "session_id", "left_semi").join(reported, on, "left_anti").select(*on, F.lit("release").alias("verdict"))
    cancel = running.where("cancel_requested_at is not null").join(known, "session_id", "left_semi").select(*on, F.lit("cancel").alias("verdict"))
    return stale.unionByName(silent).unionByName(cancel)


# -- smooth weighted round robin ------------------------------------------------

#: Weights by priority.
WEIGHTS = {4: 8, 3: 4, 2: 2, 1: 1}


def interleave(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The order in which a selector that starts without credits serves the classes of a queue, while each has work: the j-th of a class stands at (j - 1/2) / weight."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("priority")]
    nth = F.row_number().over(Window.partitionBy(*by, "priority").orderBy(*order))
    placed = df.withColumn("nth", nth).withColumn("place", (F.col("nth") - 0.5) / weight)
    return placed.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("place", F.desc("priority"), *order)).cast("long"))


def pick(credits: dict[int, int], there: list[int]) -> int:
    """One step of the selector with memory: classes with work gain their weight, the richest pays the sum."""
    for p in there:
        credits[p] += WEIGHTS[p]
    best = max(there, key=lambda p: (credits[p], p))
    credits[best] -= sum(WEIGHTS[p] for p in there)
    return best


def allocate(counts: dict[int, int], slots: int) -> dict[int, int]:
    """How many of ``slots`` each class gets, never more than it has."""
    credits, left, got = dict.fromkeys(WEIGHTS, 0), dict(counts), dict.fromkeys(counts, 0)
    for _ in range(slots):
        there = [p for p in sorted(left, reverse=True) if left[p] > 0]
        if not there:
            break
        p = pick(credits, there)
        left[p] -= 1
        got[p] += 1
    return got
