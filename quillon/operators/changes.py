"""Changes to schedules, nodes, leases and settings, bulk operations, audit rows and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scheduling import next_fixed_rate, searched, withdraw

SECOND = 1_000_000


def advance_fixed_delay(schedules: DataFrame, finished: DataFrame, now: int) -> DataFrame:
    """Fixed-delay schedules that wait for a run which has ended: their next fire is a delay from now. finished: schedule_id."""
    done = finished.select(F.col("schedule_id").alias("id")).distinct()
    waiting = (F.col("kind") == "fixed_delay") & F.col("state").isin("ACTIVE", "PAUSED") & F.col("next_fire_at").isNull()
    return schedules.where(waiting).join(done, "id", "left_semi").select("id", (F.lit(now) + F.col("every")).alias("next_fire_at"))


def first_fire(schedules: DataFrame, after: int) -> DataFrame:
    """The cursor of a new or changed schedule: the first fire after a time, not before its start; a fixed delay fires at once. Null for a schedule that cannot be planned."""
    anchor = F.coalesce("start_at", "created_at")
    from_ = F.when(F.col("start_at") > after, F.col("start_at") - 1).otherwise(F.lit(after))
    rate = F.when(F.col("every") > 0, next_fixed_rate(anchor, F.col("every"), from_))
    fire = F.when((F.col("kind") == "fixed_delay") & (F.col("every") > 0), from_ + 1).when(F.col("kind") == "fixed_rate", rate)
    if "expr" in schedules.columns:
        is_cron = F.col("kind") == "cron"
        schedules = schedules.withColumn("__found", searched(from_, F.when(is_cron, F.col("expr")), F.col("zone"), F.lit(1)))
        fire = fire.when(is_cron, F.get(F.col("__found"), 0))
    return schedules.select("id", fire.cast("long").alias("next_fire_at"))


def schedule_actions(schedules: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """schedules with an action: pause, resume, delete or trigger. jobs: the active ones.

    Pausing or deleting withdraws the runs that are not due yet: the count of fires goes back, and a paused schedule's
    cursor to the earliest of them. A resumed schedule keeps its cursor, however old; a fixed delay without one goes on
    now unless a run is active. A trigger is a fire now, outside the cadence.
    """
    gone = withdraw(jobs, now).select(F.col("schedule_id").alias("id"), F.col("withdrawn").alias("w"), F.col("next_fire_at").alias("earliest"))
    busy = jobs.select(F.col("schedule_id").alias("id")).where("id is not null").distinct().withColumn("busy", F.lit(True))
    s = schedules.join(gone, "id", "left").join(busy, "id", "left")
    is_ = lambda a, *states: (F.col("action") == a) & F.col("state").isin(*states)
    alive = F.col("state") != "DELETED"
    result = F.when(is_("pause", "ACTIVE"), "PAUSED").when(is_("resume", "PAUSED"), "ACTIVE").when((F.col("action") == "delete") & alive, "DELETED").when((F.col("action") == "trigger") & alive, F.col("state")).otherwise("CONFLICT")
    s = s.withColumn("result", result)
    back = F.col("result").isin("PAUSED", "DELETED") & (F.col("action") != "trigger")
    waits = (F.col("kind") == "fixed_delay") & F.col("next_fire_at").isNull()
    cursor = (
        F.when(F.col("result") == "DELETED", None)
        .when(back, F.least("next_fire_at", "earliest"))
        .when((F.col("action") == "resume") & (F.col("result") == "ACTIVE") & waits & F.col("busy").isNull(), F.lit(now))
        .otherwise(F.col("next_fire_at"))
    )
    fire = F.when((F.col("action") == "trigger") & (F.col("result") != "CONFLICT"), F.lit(now))
    withdrawn = F.when(back, F.coalesce("w", F.lit(0))).otherwise(0).cast("long")
    return s.select("id", "action", "result", cursor.cast("long").alias("next_fire_at"), fire.cast("long").alias("fire_time"), withdrawn.alias("withdrawn"))


def free_fire_time(wanted: DataFrame, ledger: DataFrame, tries: int = 3) -> DataFrame:
    """wanted (schedule_id, fire_time): the first of the next few microseconds that the ledger does not hold; null if it holds them all."""
    some = wanted.withColumn("f", F.explode(F.sequence(F.col("fire_time"), F.col("fire_time") + (tries - 1))))
    taken = ledger.select("schedule_id", F.col("fire_time").alias("f"))
    free = some.join(taken, ["schedule_id", "f"], "left_anti").groupBy("schedule_id", "fire_time").agg(F.min("f").alias("free"))
    return wanted.join(free, ["schedule_id", "fire_time"], "left")


def beat(nodes: DataFrame, beats: DataFrame) -> DataFrame:
    """beats: node_id, at, latest (null: no earlier beat). A late beat, or one of a node that has stopped, changes nothing; a new node's counts."""
    ok = beats.where(F.col("latest").isNull() | (F.col("at") <= F.col("latest"))).groupBy("node_id").agg(F.max("at").alias("at"))
    both = nodes.join(ok, "node_id", "full_outer")
    return both.select("node_id", F.when(F.col("stopped_at").isNotNull(), F.col("beat_at")).otherwise(F.coalesce("at", "beat_at")).alias("beat_at"), "stopped_at")


def acquire(leases: DataFrame, asks: DataFrame, now: int, ttl: int) -> DataFrame:
    """asks: name, holder, arrived. Of several, the first gets a lease that is free or has run out, with the next epoch."""
    first = Window.partitionBy("name").orderBy("arrived", "holder")
    one = asks.withColumn("n", F.row_number().over(first))
    old = leases.select("name", F.col("holder").alias("old"), "epoch", "expires_at")
    a = one.join(old, "name", "left")
    granted = (F.col("n") == 1) & (F.col("expires_at").isNull() | (F.col("expires_at") <= now))
    return a.select("name", F.col("holder"), granted.alias("granted"), F.when(granted, F.coalesce("epoch", F.lit(0)) + 1).cast("long").alias("epoch"), F.when(granted, F.lit(now + ttl)).cast("long").alias("expires_at"))


#: How long leases of pools and of single duties last, and how long before the end their holder stops.
POOL_TTL, DUTY_TTL, MARGIN = 10 * SECOND, 30 * SECOND, 2 * SECOND


def held_until(log: DataFrame, now: int, ttl: int = POOL_TTL, margin: int = MARGIN) -> DataFrame:
    """What each holder may still act on: log is id, name, holder, started, finished, outcome (acquired, renewed, failed, lost, released).

    A lease counts from the start of the request that gave it until a margin before its end, so a holder that cannot
    reach the store stops before another one starts. A failed renewal leaves it; one that is answered when the lease
    has already run out here gives it back.
    """
    w = Window.partitionBy("name", "holder").orderBy("started", "id")
    until = F.col("started") + (ttl - margin)
    given = F.col("outcome").isin("acquired", "renewed")
    steps = log.where("outcome <> 'failed'").withColumn("before", F.lag(F.when(given, until)).over(w))
    late = (F.col("outcome") == "renewed") & (F.col("before").isNull() | (F.col("finished") >= F.col("before")))
    last = steps.groupBy("name", "holder").agg(F.max_by(F.when(given & ~late, until), F.struct("started", "id")).alias("held_until"))
    return last.withColumn("held", F.coalesce(F.col("held_until") > now, F.lit(False)))


def valid_operation(kind: Column, state: Column) -> Column:
    """A bulk cancel takes active jobs, a redrive failed ones."""
    active = state.isNull() | state.isin("SCHEDULED", "READY", "RUNNING", "RETRY_PENDING", "PAUSED")
    return F.when(kind == "cancel", active).when(kind == "redrive", F.coalesce(state.isin("FAILED", "DEAD_LETTERED"), F.lit(False))).otherwise(F.lit(False))


def audit(changed: DataFrame, tenant: str, actor: str, action: Column, target: str, details: Column, at: int) -> DataFrame:
    """A row for each change, derived from the changes themselves."""
    return changed.select(F.col(tenant).alias("tenant_id"), F.lit(actor).alias("actor"), action.alias("action"), F.col(target).cast("string").alias("target"), F.to_json(details).alias("details"), F.lit(at).alias("created_at"))


def overlay(rows: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A partial update: patch has ``set_<field>`` flags; a field that is set takes the new value, null included, any other keeps the old one."""
    p = patch.select(key, *(F.col(f).alias(f"new_{f}") for f in fields), *(f"set_{f}" for f in fields))
    joined = rows.join(p, key, "left")
    return joined.select(*(F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def response(*fields: Column) -> Column:
    """JSON without the fields that are null."""
    return F.to_json(F.struct(*fields))


def batch_due(runs: DataFrame, now: int, limit: int) -> DataFrame:
    """A promotion batch: the first ``limit`` due runs by time, and the other due runs of a schedule of which an earlier one would be left out."""
    due = runs.where((F.col("state") == "SCHEDULED") & (F.col("run_at") <= now) & F.col("schedule_id").isNotNull())
    first = due.orderBy("run_at", "id").limit(limit).select("id").withColumn("batch", F.lit(True))
    marked = due.join(F.broadcast(first), "id", "left").withColumn("batch", F.coalesce("batch", F.lit(False)))
    w = Window.partitionBy("schedule_id").orderBy("fire_time", "id").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("gap", F.col("batch") & F.coalesce(F.bool_or(~F.col("batch")).over(w), F.lit(False)))
    marked = marked.withColumn("whole", F.bool_or("gap").over(Window.partitionBy("schedule_id")))
    return marked.where(F.col("batch") | F.col("whole")).select("id", "schedule_id", "fire_time", "batch")


def gauges(ready: DataFrame, classified: DataFrame, running: DataFrame, sessions: DataFrame, now: int) -> DataFrame:
    """A pool owner's gauges as series: name, pool, label, value."""
    row = lambda df, name, label, value: df.select(F.lit(name).alias("name"), "pool", label.cast("string").alias("label"), value.cast("double").alias("value"))
    by_class = classified.groupBy("pool", "priority").agg(F.sum("ready").alias("n"))
    held = ready.where("held <> ''").groupBy("pool", "held").agg(F.sum("n").alias("n"))
    cap = classified.groupBy("pool").agg(F.sum("held_cap").alias("n")).where("n > 0")
    age = classified.groupBy("pool").agg(F.min("due").alias("due")).where("due is not null")
    run = running.where("state = 'RUNNING'").groupBy("pool", "tenant_id").agg(F.count("*").alias("n"))
    slots = sessions.where("state = 'ACTIVE'").groupBy("pool").agg(F.sum("busy").alias("busy"), F.sum("free").alias("free"))
    parts = [
        row(by_class, "jobs_ready", F.col("priority"), F.col("n")),
        row(held, "jobs_held", F.col("held"), F.col("n")),
        row(cap, "jobs_held", F.lit("tenant_cap"), F.col("n")),
        row(age, "jobs_oldest_ready_age", F.lit(""), (F.lit(now) - F.col("due")) / SECOND),
        row(run, "jobs_running", F.col("tenant_id"), F.col("n")),
        row(slots, "worker_slots", F.lit("busy"), F.col("busy")),
        row(slots, "worker_slots", F.lit("free"), F.col("free")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
