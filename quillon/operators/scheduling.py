"""Schedules: fire planning, materializing, promotion and overlap policies, as set operations."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import cron, hashing

SECOND = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Bounds of one planning pass; times in microseconds."""

    lookahead: int = 150 * SECOND
    misfire_threshold: int = 60 * SECOND
    max_misfires: int = 100
    max_fires: int = 1_000
    max_scan: int = 1_000_000


def next_fixed_rate(anchor: Column, every: Column, after: Column) -> Column:
    """The first fire strictly after a time."""
    return F.when(after < anchor, anchor).otherwise(anchor + (_div(after - anchor, every) + 1) * every)


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers, exact for 64 bits."""
    return ((a - a % b) / b).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once; a column that others refer to would be written out, and computed, in each of them."""
    return F.transform(F.array(value), body)[0]


def plan_fixed(schedules: DataFrame, now: int, limits: Limits = Limits()) -> DataFrame:
    """Adds first, n_fires, next, completed to schedules with kind, misfire, every, next_fire_at, end_at, max_runs, fire_count.

    Fires are first + i * every for i < n_fires. The cursor of a fixed rate is one of its fires.
    """
    cursor, every, end = F.col("next_fire_at"), F.col("every"), F.col("end_at")
    horizon = now + limits.lookahead
    delay = F.col("kind") == "fixed_delay"

    def start(_) -> Column:
        missed = F.least(_div(F.greatest(F.lit(now) - cursor, F.lit(0)), every), F.lit(limits.max_scan - 1))
        late = cursor < now - limits.misfire_threshold
        after_now = cursor + (_div(F.lit(now) - cursor, every) + 1) * every
        first = F.when(delay | ~late, cursor).when(F.col("misfire") == "skip", after_now).otherwise(cursor + F.when(F.col("misfire") == "fire_all", F.greatest(F.lit(0), missed - (max(limits.max_misfires, 1) - 1))).otherwise(missed) * every)
        remaining = F.when(F.col("max_runs").isNotNull() & (F.col("max_runs") > 0), (F.col("max_runs") - F.col("fire_count")).cast("long")).otherwise(F.lit(1 << 62))
        return F.struct(first.cast("long").alias("first"), remaining.alias("remaining"))

    def count(p: Column) -> Column:
        there = F.when(p["first"] > horizon, F.lit(0).cast("long")).otherwise(F.least(F.lit(limits.max_fires), _div(F.greatest(F.lit(horizon) - p["first"], F.lit(0)), every) + 1))
        inside = F.when(end.isNull(), F.lit(1 << 62)).when(p["first"] > end, F.lit(0)).otherwise(_div(F.greatest(end - p["first"], F.lit(0)), every) + 1)
        return F.struct(p["first"].alias("first"), p["remaining"].alias("remaining"), there.cast("long").alias("there"), inside.cast("long").alias("inside"))

    def keep(p: Column) -> Column:
        after = p["first"] + p["there"] * every
        kept = F.least(p["there"], p["inside"], p["remaining"])
        done = (kept < p["there"]) | F.coalesce(after > end, F.lit(False)) | (kept >= p["remaining"])
        over = (p["remaining"] <= 0) | F.coalesce(cursor > end, F.lit(False))
        return F.struct(p["first"].alias("first"), p["remaining"].alias("remaining"), kept.alias("kept"), after.alias("after"), done.alias("done"), over.alias("over"))

    def result(p: Column) -> Column:
        n = F.when(cursor.isNull() | p["over"] | (cursor > horizon), 0).when(delay, 1).otherwise(p["kept"]).cast("long")
        completed = F.when(cursor.isNull(), False).when(p["over"], True).when(cursor > horizon, False).when(delay, p["remaining"] == 1).otherwise(p["done"])
        following = F.when(cursor.isNull() | p["over"], None).when(cursor > horizon, cursor).when(delay | p["done"], None).otherwise(p["after"])
        return F.struct(p["first"].alias("first"), n.alias("n_fires"), following.cast("long").alias("next"), completed.alias("completed"))

    plan = _let(_let(_let(_let(F.lit(True), start), count), keep), result)
    planned = schedules.withColumn("__plan", plan)
    return planned.withColumns({c: F.col(f"__plan.{c}") for c in ("first", "n_fires", "next", "completed")}).drop("__plan")


CRON_PLAN = "fires array<long>, next long, completed boolean, error string"


def plan_cron(cursor: int, expr: str, zone: str | None, misfire: str, end: int | None, left: int | None, now: int, limits: Limits) -> tuple[list[int], int | None, bool]:
    """(fires, cursor, completed) of one cron schedule whose cursor is one of its fires; ``left``: runs that it may still have."""
    own, horizon = cron.compiled(expr, zone), now + limits.lookahead
    over = lambda t: end is not None and t > end
    if over(cursor) or (left is not None and left <= 0):
        return [], None, True
    if cursor > horizon:
        return [], cursor, False
    found, following = [], cursor
    if cursor < now - limits.misfire_threshold:
        kept = {"skip": 0, "fire_all": max(1, limits.max_misfires)}.get(misfire, 1)
        found = own.upto(now, kept, cursor) if kept else []
        following = own.after(now)
    while following is not None and following <= horizon and len(found) < limits.max_fires:
        found.append(following)
        following = own.after(following)
    fit = [t for t in found if not over(t)][:left]
    done = len(fit) < len(found) or following is None or over(following) or len(fit) == left
    return fit, None if done else following, done


def _cron_plans(now: int, limits: Limits):
    @F.pandas_udf(CRON_PLAN)
    def plans(cursor: pd.Series, expr: pd.Series, zone: pd.Series, misfire: pd.Series, end: pd.Series, left: pd.Series) -> pd.DataFrame:
        whole = lambda x: None if pd.isna(x) else int(x)

        def one(at, text, where, policy, last, runs):
            if text is None or pd.isna(at):
                return None, whole(at), False, None
            try:
                return *plan_cron(int(at), text, where, policy, whole(last), whole(runs), now, limits), None
            except ValueError as e:
                return None, int(at), False, str(e)

        rows = [one(*row) for row in zip(cursor, expr, zone, misfire, end, left, strict=True)]
        out = pd.DataFrame(rows, columns=["fires", "next", "completed", "error"], dtype=object)
        return out.astype({"next": "Int64", "completed": bool})

    return plans


def plan(schedules: DataFrame, now: int, limits: Limits = Limits()) -> DataFrame:
    """Adds fires (array), n_fires, next, completed, error to schedules with kind, misfire, every, expr, zone, next_fire_at, end_at, max_runs, fire_count.

    Fixed rates and delays are arithmetic; cron expressions are searched from the cursor, a batch of schedules at a
    time. A trigger of another kind, a rate or delay that is not positive, a malformed expression and an unknown zone
    are errors: no fires, and the cursor stays.
    """
    is_cron = F.col("kind") == "cron"
    left = F.when(F.col("max_runs") > 0, (F.col("max_runs") - F.col("fire_count")).cast("long"))
    text = lambda c: F.when(is_cron, F.col(c) if c in schedules.columns else F.lit(None)).cast("string")
    planned = plan_fixed(schedules.withColumn("every", F.when(F.col("kind").isin("fixed_rate", "fixed_delay") & (F.col("every") > 0), F.col("every"))), now, limits)
    searched = _cron_plans(now, limits)(F.col("next_fire_at"), F.coalesce(text("expr"), F.when(is_cron, "")), text("zone"), F.col("misfire"), F.col("end_at"), left)
    planned = planned.withColumn("c", searched)
    wrong = F.when(~is_cron & ~F.coalesce(F.col("kind").isin("fixed_rate", "fixed_delay"), F.lit(False)), "unknown trigger kind").when(~is_cron & F.col("every").isNull(), "interval must be positive")
    planned = planned.withColumn("error", F.coalesce(wrong, F.when(F.col("kind").isNull(), "unknown trigger kind"), F.col("c.error")))
    bad, either = F.col("error").isNotNull(), lambda a, b: F.when(is_cron, a).otherwise(b)
    grid = F.when(F.col("n_fires") > 0, F.expr("transform(sequence(0L, n_fires - 1), i -> first + i * coalesce(every, 0L))"))
    none = F.array().cast("array<long>")
    planned = planned.withColumn("fires", F.when(bad, none).otherwise(F.coalesce(either(F.col("c.fires"), grid), none)))
    planned = planned.withColumn("next", F.when(bad, F.col("next_fire_at")).otherwise(either(F.col("c.next"), F.col("next"))))
    planned = planned.withColumn("completed", ~bad & either(F.col("c.completed"), F.col("completed")))
    return planned.withColumn("n_fires", F.size("fires").cast("long")).drop("c", "first")


def fires(planned: DataFrame) -> DataFrame:
    """A row for each planned fire: schedule_id, fire_time, run_at (the fire and its jitter, where schedules have ``jitter_ms``)."""
    jitter = F.col("jitter_ms").cast("long") if "jitter_ms" in planned.columns else F.lit(None).cast("long")
    some = planned.select(F.col("id").alias("schedule_id"), F.explode("fires").alias("fire_time"), jitter.alias("jitter_ms"), "tenant_id", "job_type")
    if "jitter_ms" not in planned.columns:
        return some.withColumn("run_at", F.col("fire_time")).drop("jitter_ms")
    shift = F.coalesce(hashing.jitter_ms(F.col("schedule_id").cast("string"), F.col("fire_time"), F.coalesce("jitter_ms", F.lit(0))), F.lit(0)) * 1000
    return some.withColumn("run_at", F.col("fire_time") + shift).drop("jitter_ms")


def materialize_due(schedules: DataFrame, job_types: DataFrame, ledger: DataFrame, now: int, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(fires that are new, cursor updates): active schedules of enabled types; a fire that the ledger has is not repeated, a schedule that cannot be planned is left as it is."""
    enabled = job_types.where("enabled").select("tenant_id", F.col("name").alias("job_type"))
    due = schedules.where((F.col("state") == "ACTIVE") & (F.col("next_fire_at") <= now + limits.lookahead)).join(enabled, ["tenant_id", "job_type"], "left_semi")
    planned = plan(due, now, limits).where("error is null")
    new = fires(planned).join(ledger.select("schedule_id", "fire_time"), ["schedule_id", "fire_time"], "left_anti")
    last = F.when(F.col("n_fires") > 0, F.array_max("fires"))
    updates = planned.select("id", "next", (F.col("fire_count") + F.col("n_fires")).alias("fire_count"), last.alias("last_fire"), F.when(F.col("completed"), "COMPLETED").otherwise("ACTIVE").alias("state"))
    return new, updates


def searched(after: Column, expr: Column, zone: Column, most: Column) -> Column:
    """The next fires of cron expressions strictly after an instant; none where the expression is null or wrong."""

    @F.pandas_udf("array<long>")
    def search(after: pd.Series, expr: pd.Series, zone: pd.Series, most: pd.Series) -> pd.Series:
        def one(at, text, where, n):
            out: list[int] = []
            try:
                while text is not None and not pd.isna(at) and len(out) < n and (at := cron.compiled(text, where).after(int(at))) is not None:
                    out.append(at)
            except ValueError:
                return []
            return out

        return pd.Series([one(*r) for r in zip(after, expr, zone, most, strict=True)], dtype=object)

    return search(after, expr, zone, most)


def upcoming(schedules: DataFrame, n: int) -> DataFrame:
    """Up to n fires from the cursor on, within end and runs: schedule_id, nth, fire_time. Schedules that cannot be planned have none."""
    left = F.when(F.col("max_runs") > 0, F.least(F.lit(n), F.col("max_runs") - F.col("fire_count"))).otherwise(n)
    is_cron = F.col("kind") == "cron"
    s = schedules.where("next_fire_at is not null").withColumn("n", F.when(F.col("kind") == "fixed_delay", F.least(F.lit(1), left)).otherwise(left)).where("n > 0")
    grid = F.when(F.col("kind").isin("fixed_rate", "fixed_delay") & (F.col("every") > 0), F.expr("transform(sequence(0, n - 1), i -> next_fire_at + i * every)"))
    if "expr" in schedules.columns:
        # The cursor is a fire itself, so the search begins just before it.
        s = s.withColumn("found", searched(F.col("next_fire_at") - 1, F.when(is_cron, F.col("expr")), F.col("zone"), F.col("n")))
        grid = F.when(is_cron, F.col("found")).otherwise(grid)
    rows = s.select("id", "end_at", F.posexplode(grid).alias("nth", "fire_time"))
    return rows.where("end_at is null or fire_time <= end_at").select(F.col("id").alias("schedule_id"), "nth", "fire_time")


def min_gap(fired: DataFrame, by: str = "schedule_id", at: str = "fire_time") -> DataFrame:
    """The smallest distance of consecutive fires."""
    gap = F.lead(at).over(Window.partitionBy(by).orderBy(at)) - F.col(at)
    return fired.withColumn("gap", gap).groupBy(by).agg(F.min("gap").alias("min_gap"))


#: When a buffered run is looked at again.
BUFFER_RECHECK = 5 * SECOND


# -- promotion -----------------------------------------------------------------


def earlier_runs(runs: DataFrame) -> DataFrame:
    """Adds how many earlier runs of the schedule are active, and how many wait: a window over the schedule's runs, not a join of each with all."""
    before = Window.partitionBy("schedule_id").orderBy("fire_time", "id").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *states: F.coalesce(F.sum(F.col("state").isin(*states).cast("int")).over(before), F.lit(0)).cast("long")
    return runs.withColumn("earlier_active", count("READY", "RUNNING", "RETRY_PENDING")).withColumn("earlier_waiting", count("SCHEDULED"))


def overlap_decisions(runs: DataFrame, schedules: DataFrame, now: int) -> DataFrame:
    """Decides due runs of schedules: runs need id, schedule_id, fire_time, state, run_at. The policy's state machine in closed form: rn-th of cnt due runs, k counts an active earlier one."""
    marked = earlier_runs(runs.where("schedule_id is not null"))
    due = marked.where((F.col("state") == "SCHEDULED") & (F.col("run_at") <= now))
    policies = schedules.select(F.col("id").alias("schedule_id"), "overlap")
    due = due.join(policies, "schedule_id")
    w = Window.partitionBy("schedule_id").orderBy("fire_time", "id")
    due = due.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("cnt", F.count("*").over(Window.partitionBy("schedule_id")))
    due = due.withColumn("active", F.first(F.col("earlier_active") > 0).over(w)).withColumn("waiting", F.first(F.col("earlier_waiting") > 0).over(w))
    k = F.col("rn") + F.col("active").cast("int")
    decision = (
        F.when(F.col("overlap") == "allow", "PROMOTE")
        .when(F.col("overlap") == "buffer_one", F.when(F.col("waiting"), "SKIP").when(k == 1, "PROMOTE").when(k == 2, "BUFFER").otherwise("SKIP"))
        .when(F.col("overlap") == "cancel_previous", F.when(F.col("rn") < F.col("cnt"), "SUPERSEDED").otherwise("PROMOTE"))
        .otherwise(F.when(k == 1, "PROMOTE").otherwise("SKIP"))
    )
    due = due.withColumn("decision", decision)
    return due.select("id", "schedule_id", "fire_time", "overlap", "rn", "cnt", "active", "decision", F.when(F.col("decision") == "BUFFER", F.lit(now + BUFFER_RECHECK)).otherwise(F.col("run_at")).alias("run_at"))


def promoted(due: DataFrame, now: int) -> DataFrame:
    """Due jobs as they become ready: state, ready_at, and how long after their time (microseconds)."""
    return due.withColumns({"state": F.lit("READY"), "ready_at": F.lit(now), "lag": F.lit(now) - F.col("run_at")})


def last_fires(ledger: DataFrame) -> DataFrame:
    """The latest fire of each schedule that the ledger knows."""
    return ledger.where("schedule_id is not null").groupBy("schedule_id").agg(F.max("fire_time").alias("last_fire"))


def superseded(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Runs promoted earlier that a newer run of a cancel_previous schedule replaces: waiting ones are cancelled, running ones asked to stop."""
    winners = decisions.where("overlap = 'cancel_previous' and decision = 'PROMOTE' and active").select("schedule_id", F.col("fire_time").alias("newest"))
    old = runs.join(winners, "schedule_id").where((F.col("fire_time") < F.col("newest")) & F.col("state").isin("READY", "RETRY_PENDING", "RUNNING"))
    return old.select("id", F.when(F.col("state") == "RUNNING", "REQUEST_CANCEL").otherwise("CANCELLED").alias("action"))


def withdraw(jobs: DataFrame, now: int) -> DataFrame:
    """Provisional runs of a schedule that has changed: how many go, and the cursor's new place."""
    gone = jobs.where((F.col("state") == "SCHEDULED") & (F.col("run_at") > now) & F.col("schedule_id").isNotNull())
    return gone.groupBy("schedule_id").agg(F.count("*").alias("withdrawn"), F.min("fire_time").alias("next_fire_at"))
