"""Submitting jobs: validation, idempotency, de-duplication, quotas, load shedding, rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import text

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Rules for names and labels.
NAME = "^[a-z0-9][a-z0-9._-]{0,99}$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAX_LABELS, MAX_KEY, MAX_VALUE, MAX_DEDUPE, MAX_CORRELATION = 16, 64, 256, 255, 128
#: Roles, weakest first.
ROLES = ("viewer", "submitter", "operator", "admin", "platform-admin")
PRIORITIES = ("LOW", "NORMAL", "HIGH", "CRITICAL")


def priority_number(name: Column) -> Column:
    """1 to 4, any case; null if it is none."""
    return F.nullif(F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.upper(name)).cast("int"), F.lit(0))


def priority_name(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PRIORITIES)), number)


def includes(role: Column, least: Column) -> Column:
    """Whether a role may do what another one may."""
    order = F.array(*(F.lit(r) for r in ROLES))
    return (F.array_position(order, role) > 0) & (F.array_position(order, role) >= F.array_position(order, least))


def usable(now: int) -> Column:
    """A credential that is neither revoked nor expired."""
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.lit(now) < F.col("expires_at")))


def canonical_uuid(written: Column) -> Column:
    """Lower case, or null if it is no UUID."""
    low = F.lower(written)
    return F.when(low.rlike(UUID), low)


def violations(name: Column, labels: Column, dedupe_key: Column, correlation_id: Column) -> Column:
    """All rules that a submission breaks."""
    keys, values = F.map_keys(labels), F.map_values(labels)
    found = F.array(
        F.when(~name.rlike(NAME), "name"),
        F.when(F.size(keys) > MAX_LABELS, "labels"),
        F.when(F.exists(keys, lambda k: (F.char_length(k) < 1) | (F.char_length(k) > MAX_KEY)), "label key"),
        F.when(F.exists(values, lambda v: F.char_length(v) > MAX_VALUE), "label value"),
        F.when(F.char_length(dedupe_key) > MAX_DEDUPE, "dedupe_key"),
        F.when(F.char_length(correlation_id) > MAX_CORRELATION, "correlation_id"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def _in_order(rows: DataFrame, key: list[str], fold, schema: str) -> DataFrame:
    """A fold over each key's rows by (ts, id): rows stream through a task in that order, only the state of the key at hand is held. fold(key) gives a function of a row that returns what the row becomes."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        at, step = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = tuple(getattr(row, c) for c in key)
                if k != at:
                    at, step = k, fold(k)
                out.append(k + step(row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key, "ts", "id").mapInPandas(run, schema)


USES = "tenant_id int, idempotency_key string, id long, owner long, outcome string"


def first_use(requests: DataFrame, ttl: int = DAY) -> DataFrame:
    """Idempotency: within a tenant and key, the request that claims it (the first, or the first after a claim's end) and what the others are to it.

    Keys all of whose requests lie within one claim, nearly all where keys are used once, are a window; only those
    whose requests outlast a claim are folded.
    """
    key = ["tenant_id", "idempotency_key"]
    keyed = requests.where("idempotency_key is not null").select("tenant_id", "idempotency_key", "ts", "id", F.sha2(F.col("body"), 256).alias("hash"))
    w = Window.partitionBy(*key).orderBy("ts", "id")
    first = F.first(F.struct("id", "hash", "ts")).over(w)
    seen = keyed.withColumn("first", first).withColumn("last", F.max("ts").over(Window.partitionBy(*key)))
    once = F.col("last") < F.col("first.ts") + ttl
    outcome = F.when(F.col("id") == F.col("first.id"), "created").when(F.col("hash").eqNullSafe(F.col("first.hash")), "replayed").otherwise("key_reused")
    simple = seen.where(once).select(*key, "id", F.col("first.id").alias("owner"), outcome.alias("outcome"))

    def fold(key):
        claim = [-1, None, None]  # until, owner, hash

        def step(r):
            if r.ts >= claim[0]:
                claim[:] = r.ts + ttl, r.id, r.hash
                return r.id, r.id, "created"
            return r.id, claim[1], "replayed" if r.hash == claim[2] else "key_reused"

        return step

    return simple.unionByName(_in_order(seen.where(~once).select(*keyed.columns), key, fold, USES))


#: How long a server remembers what it has read.
QUOTA_TTL, PENDING_TTL, BACKLOG_TTL, CAPS_TTL, AUTH_TTL = 30 * SECOND, 5 * SECOND, 2 * SECOND, 10 * SECOND, 30 * SECOND
FETCHES = "key string, id long, fetched_at long"


def through_cache(reads: DataFrame, values: DataFrame, ttl: int, until: str | None = None) -> DataFrame:
    """What reads (key, ts, id) see of values (key, at, value) through a cache: key, id, fetched_at, value.

    A read asks the store if no other has asked, or if the last one's answer has reached its time to live, and then
    sees the value of that moment (null before the first); the others see what it saw. ``until`` names a column of
    the reads with an instant that ends an answer earlier, such as the end of a credential.
    """

    def fold(key):
        held = [None, None]  # fetched, until

        def step(r):
            if held[0] is None or r.ts >= held[1]:
                held[:] = r.ts, r.ts + ttl if r.ends is None or r.ends != r.ends else min(r.ts + ttl, r.ends)
            return r.id, held[0]

        return step

    ends = F.col(until) if until else F.lit(None)
    asked = _in_order(reads.select("key", "ts", "id", ends.cast("long").alias("ends")), ["key"], fold, FETCHES)
    # the store's value at each fetch: the last change up to it
    seen = values.select("key", F.col("at").alias("t"), F.lit(0).alias("asks"), F.struct("value").alias("v"))
    seen = seen.unionByName(asked.select("key", F.col("fetched_at").alias("t"), F.lit(1).alias("asks")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("asks = 1")
    return asked.join(seen.select("key", F.col("t").alias("fetched_at"), F.col("v.value").alias("value")), ["key", "fetched_at"]).select("key", "id", "fetched_at", "value")


def deduplicate(created: DataFrame, active: DataFrame) -> DataFrame:
    """created: tenant_id, dedupe_key, ts, id. A job whose key an active job or an earlier one of the batch has is not created again."""
    held = active.where("dedupe_key is not null").select("tenant_id", "dedupe_key", F.col("id").alias("held_by")).groupBy("tenant_id", "dedupe_key").agg(F.min("held_by").alias("held_by"))
    first = F.first("id").over(Window.partitionBy("tenant_id", "dedupe_key").orderBy("ts", "id"))
    keyed = created.where("dedupe_key is not null").withColumn("first", first).join(held, ["tenant_id", "dedupe_key"], "left")
    job = F.coalesce("held_by", "first")
    out = keyed.select("id", job.alias("job_id"), F.when(job == F.col("id"), "created").otherwise("deduplicated").alias("outcome"))
    return out.unionByName(created.where("dedupe_key is null").select("id", F.col("id").alias("job_id"), F.lit("created").alias("outcome")))


def pending_quota(jobs: DataFrame, tenants: DataFrame, default: int) -> DataFrame:
    """tenant_id, pending (counted up to the quota), allowed."""
    pending = jobs.where(F.col("state").isin("SCHEDULED", "READY", "RETRY_PENDING")).groupBy("tenant_id").agg(F.count("*").alias("n"))
    t = tenants.select(F.col("id").alias("tenant_id"), F.coalesce("max_pending", F.lit(default)).alias("quota"))
    return t.join(pending, "tenant_id", "left").select("tenant_id", "quota", F.least(F.coalesce("n", F.lit(0)), F.col("quota")).cast("long").alias("pending")).withColumn("allowed", F.col("pending") < F.col("quota"))


def schedule_quota(schedules: DataFrame, tenants: DataFrame, default: int) -> DataFrame:
    used = schedules.where(F.col("state").isin("ACTIVE", "PAUSED")).groupBy("tenant_id").agg(F.count("*").alias("n"))
    t = tenants.select(F.col("id").alias("tenant_id"), F.coalesce("max_schedules", F.lit(default)).alias("quota"))
    return t.join(used, "tenant_id", "left").select("tenant_id", "quota", F.coalesce("n", F.lit(0)).cast("long").alias("used")).withColumn("allowed", F.col("used") < F.col("quota"))


def shed(priority: Column, age_ms: Column, target_ms: Column, fresh: Column, saturated: Column | None = None) -> Column:
    """Whether a submission is refused for load: low priority past the target, normal past three times it, never above; a stale or missing sample sheds nothing."""
    known = fresh & age_ms.isNotNull() & target_ms.isNotNull()
    over = F.when(known, F.when(priority == 1, age_ms > target_ms).when(priority == 2, age_ms > 3 * target_ms).otherwise(False)).otherwise(False)
    return F.coalesce(over | ((priority == 1) & saturated) if saturated is not None else over, F.lit(False))


def token_bucket(requests: DataFrame, by: str, rate: str, burst: float = 2.0, default: float = 10.0) -> DataFrame:
    """Requests (by, ts, id, rate) through a bucket of burst * rate tokens that refills by rate a second: id, allowed, wait (seconds until a token).

    No rate is the default one; a rate of 0 or less lets nothing pass, and its wait has no end.
    """

    def fold(key):
        tokens, last = None, None

        def step(r):
            nonlocal tokens, last
            if not r.rate > 0:
                tokens, last = 0.0, r.ts
                return int(r.id), False, float("inf")
            full = burst * r.rate
            tokens = full if tokens is None else min(full, tokens + (r.ts - last) / SECOND * r.rate)
            last = r.ts
            if tokens >= 1:
                tokens -= 1
                return int(r.id), True, 0.0
            return int(r.id), False, (1 - tokens) / r.rate

        return step

    rows = requests.select(by, "ts", "id", F.coalesce(F.col(rate).cast("double"), F.lit(default)).alias("rate"))
    kind = rows.schema[by].dataType.simpleString()
    return _in_order(rows, [by], fold, f"{by} {kind}, id long, allowed boolean, wait double")


#: Bounds of an attempt's timeout in microseconds; how old a load sample may be.
TIMEOUTS = (SECOND, DAY)
SAMPLE_AGE = 60 * SECOND


def is_fresh(sampled_at: Column, now: int) -> Column:
    """Whether a sample of the load is young enough to refuse anything by."""
    return F.coalesce(sampled_at > now - SAMPLE_AGE, F.lit(False))


def resolve(asked: DataFrame, job_types: DataFrame, now: int) -> DataFrame:
    """Submissions with their type's defaults: id, priority, timeout (microseconds), run_at, rejected (the first reason against it, null: none).

    asked: id, tenant_id, job_type, priority (a name), attempt_timeout and delay (as written), run_at, role. job_types: tenant_id, name,
    enabled, attempt_timeout_ms, default_priority.
    """
    types = job_types.select("tenant_id", F.col("name").alias("job_type"), "enabled", "attempt_timeout_ms", "default_priority")
    s = asked.join(types, ["tenant_id", "job_type"], "left")
    delay, timeout, level = text.duration_micros(F.col("delay")), text.duration_micros(F.col("attempt_timeout")), priority_number(F.col("priority"))
    named = F.coalesce(F.col("priority"), F.lit("")) != ""
    own = F.coalesce(F.col("attempt_timeout"), F.lit("")) != ""
    late = F.coalesce(F.col("delay"), F.lit("")) != ""
    priority = F.when(named, level).otherwise(F.col("default_priority"))
    broken = lambda c: ~F.coalesce(c, F.lit(False))
    why = (
        F.when(late & F.col("run_at").isNotNull(), "delay")
        .when(late & broken(delay >= 0), "delay")
        .when(F.col("job_type").isNull() | broken(F.col("enabled")), "type")
        .when(named & level.isNull(), "priority")
        .when(own & broken(timeout.between(*TIMEOUTS)), "attempt_timeout")
        .when((priority == 4) & broken(includes(F.col("role"), F.lit("operator"))), "critical needs operator")
    )
    at = F.when(late, F.lit(now) + delay).otherwise(F.col("run_at"))
    return s.select("id", priority.cast("int").alias("priority"), F.when(own, timeout).otherwise(F.col("attempt_timeout_ms") * 1000).alias("timeout"), F.coalesce(at, F.lit(now)).alias("run_at"), why.alias("rejected"))


def new_jobs(accepted: DataFrame, now: int) -> DataFrame:
    """Accepted submissions (id, run_at, ...) as jobs: due ones are ready at once, the others scheduled."""
    due = F.col("run_at") <= now
    return accepted.withColumn("state", F.when(due, "READY").otherwise("SCHEDULED")).withColumn("ready_at", F.when(due, F.lit(now)).cast("long")).withColumn("attempt_count", F.lit(0)).withColumn("created_at", F.lit(now))
