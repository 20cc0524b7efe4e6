"""Lookups, filtered lists with keyset pages, and the pool, session and backlog views."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

SECOND = 1_000_000
MAX_PAGE, DEFAULT_PAGE = 200, 50


def all_jobs(active: DataFrame, history: DataFrame) -> DataFrame:
    """One relation over both tables; ``source`` lets a filter on it prune a side."""
    return active.withColumn("source", F.lit("active")).unionByName(history.withColumn("source", F.lit("history")), allowMissingColumns=True)


def list_filter(state: str | None = None, job_type=None, schedule=None, label: tuple[str, str] | None = None, labels: dict[str, str] | None = None, since: int | None = None, until: int | None = None, after: tuple[int, int] | None = None) -> Column:
    """The conditions that are given; created time from ``since`` on and before ``until``; ``after`` is the last row of the page before, newest first."""
    cond = F.lit(True)
    if state is not None:
        cond &= F.col("state") == state
    if job_type is not None:
        cond &= F.col("job_type") == job_type
    if schedule is not None:
        cond &= F.col("schedule_id") == schedule
    if label is not None:
        cond &= F.col(label[0]) == label[1]
    for k, v in (labels or {}).items():  # a map holds all of them
        cond &= F.coalesce(F.element_at("labels", F.lit(k)) == v, F.lit(False))
    if since is not None:
        cond &= F.col("created_at") >= since
    if until is not None:
        cond &= F.col("created_at") < until
    if after is not None:
        cond &= (F.col("created_at") < after[0]) | ((F.col("created_at") == after[0]) & (F.col("id") < after[1]))
    return cond


def page(rows: DataFrame, where: Column, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The newest ``limit`` rows and one more, which tells that there is another page."""
    return rows.where(where).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, MAX_PAGE)) + 1)


def cursor(created_at: Column, id_: Column) -> Column:
    """A page's end as URL-safe base64, without padding, of JSON {t, id}."""
    text = F.to_json(F.struct(created_at.alias("t"), id_.alias("id")))
    return F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/=\r\n", "-_"))


def read_cursor(text: str) -> tuple[int, int]:
    data = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    return data["t"], data["id"]


def attempts_of(attempts: DataFrame, sessions: DataFrame, running: DataFrame) -> DataFrame:
    """Ended attempts with their workers' names, and the running one last."""
    names = sessions.select(F.col("id").alias("session_id"), "worker_id")
    now = running.where("state = 'RUNNING'").select(F.col("id").alias("job_id"), F.col("attempt_count").cast("bigint").alias("number"), "session_id", F.lit("RUNNING").alias("state"), F.col("attempt_started_at").alias("started_at"), F.lit(1).alias("last"))
    ended = attempts.select("job_id", F.col("number").cast("bigint").alias("number"), "session_id", "state", "started_at", F.lit(0).alias("last"))
    return ended.unionByName(now).join(names, "session_id", "left")


def pools_overview(pools: DataFrame, sessions: DataFrame, jobs: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Every pool that is known by name, by a session or by a job, with workers, slots, jobs and its owner, if the lease still holds. Each side is summed before it is joined."""
    live = sessions.where("state = 'ACTIVE'")
    names = pools.select("name").union(live.select("pool")).union(jobs.where("state in ('READY', 'RUNNING')").select("pool")).distinct().toDF("name")
    workers = live.groupBy(F.col("pool").alias("name")).agg(F.count("*").alias("workers"), F.sum("slots").alias("slots"))
    counts = jobs.groupBy(F.col("pool").alias("name")).agg(F.count_if(F.col("state") == "READY").alias("ready"), F.count_if(F.col("state") == "RUNNING").alias("running"))
    owner = leases.where((F.col("expires_at") > now) & F.col("name").startswith("pool:")).select(F.expr("substring(name, 6)").alias("name"), "holder")
    out = names.join(pools, "name", "left").join(workers, "name", "left").join(counts, "name", "left").join(owner, "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("name", F.coalesce("paused", F.lit(False)).alias("paused"), zero("workers"), zero("slots"), zero("ready"), zero("running"), "holder")


def sessions_overview(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sessions with their running attempts; busy and free slots."""
    held = jobs.where("state = 'RUNNING'").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("running"))
    s = sessions.join(held, "id", "left").withColumn("running", F.coalesce("running", F.lit(0)))
    return s.withColumn("busy", F.least("running", "slots").cast("long")).withColumn("free", (F.col("slots") - F.col("busy")).cast("long"))


def ready_rollup(jobs: DataFrame, job_types: DataFrame, pools: DataFrame, claimable: Column) -> DataFrame:
    """Ready jobs by pool, priority, tenant and what holds them; a paused pool is named before a paused type."""
    types = job_types.where("paused").select("tenant_id", F.col("name").alias("job_type"), F.lit(True).alias("type_paused"))
    stopped = pools.where("paused").select(F.col("name").alias("pool"), F.lit(True).alias("pool_paused"))
    j = jobs.where(claimable).join(types, ["tenant_id", "job_type"], "left").join(stopped, "pool", "left")
    reason = F.when(F.col("pool_paused"), "pool_paused").when(F.col("type_paused"), "job_type_paused").otherwise("")
    return j.groupBy("pool", "priority", "tenant_id", reason.alias("held")).agg(F.count("*").alias("n"), F.min("run_at").alias("due"))


def classify_backlog(rollup: DataFrame, allowance: DataFrame) -> DataFrame:
    """What of the ready jobs can be dispatched: of a tenant over its cap only what the cap lets start, most urgent first, and it sets no age. Adds ready, held_cap and due (null where it does not count)."""
    free = rollup.where("held = ''").join(allowance, ["pool", "tenant_id"], "left")
    tenant = Window.partitionBy("pool", "tenant_id")
    before = F.coalesce(F.sum("n").over(tenant.orderBy(F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.col("allowance").isNotNull() & (F.col("allowance") < F.col("total"))
    free = free.withColumn("total", F.sum("n").over(tenant)).withColumn("before", before)
    take = F.when(over, F.greatest(F.lit(0), F.least(F.col("n"), F.col("allowance") - F.col("before")))).otherwise(F.col("n"))
    return free.withColumn("ready", take.cast("long")).withColumn("held_cap", (F.col("n") - F.col("ready")).cast("long")).withColumn("due", F.when(~over, F.col("due")))


def wanted_pools(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pools with live workers, or known and with ready jobs."""
    known = sessions.select("pool").distinct()
    live = sessions.where("state = 'ACTIVE'").select("pool")
    waiting = known.join(jobs.where("state = 'READY'").select("pool"), "pool", "left_semi")
    return live.union(waiting).distinct()


def unowned(pools: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Pools without a lease that still holds."""
    held = leases.where(F.col("expires_at") > now).select(F.col("name").alias("lease"))
    return pools.join(held, F.concat(F.lit("pool:"), F.col("pool")) == F.col("lease"), "left_anti")


def holds_lease(claims: DataFrame, leases: DataFrame) -> DataFrame:
    """Claims (name, holder, epoch) that the table confirms; the end of the lease does not matter for the fence."""
    return claims.join(leases.select("name", "holder", "epoch"), ["name", "holder", "epoch"], "left_semi")


def retention(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """How many rows of each table a cutoff removes: table, rows."""
    parts = [df.where(gone).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, (df, gone) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key: a rewrite, as the files cannot be changed in place."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def move(rows: DataFrame, where: Column, **overrides: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what moves with the overrides applied); a condition that is null does not move a row."""
    gone = F.coalesce(where, F.lit(False))
    return rows.where(~gone), rows.where(gone).withColumns(overrides)


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """Rows of the given keys; equality reaches the scan as a pushed filter."""
    cond = F.lit(True)
    for name, value in keys.items():
        cond &= F.col(name) == value
    return rows.where(cond)


def zipped(spark, schema: str, *columns: list) -> DataFrame:
    """Parallel arrays, such as a request's parameters, as a relation."""
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema)


def in_scope(rows: DataFrame, pool: str) -> DataFrame:
    """Rows that a credential of a pool may see; an empty pool means all."""
    return rows.where(F.col("pool") == pool) if pool else rows
