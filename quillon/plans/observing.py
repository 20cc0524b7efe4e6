"""Queries about metrics: counters, histograms, quantiles, rates, alerts, the load gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators import metrics
from quillon.sources.views import DAY, HOUR, NOW

from .registry import Tables, query

BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 4.0)
#: Events lie in 30 days from here.
START = 1_704_067_200_000_000
BUCKETS = f"buckets AS (SELECT outcome, le, count(*) FILTER (WHERE seconds <= le) AS n FROM metrics, (VALUES {', '.join(f'({b})' for b in BOUNDS)}, (CAST('inf' AS DOUBLE))) v(le) GROUP BY ALL)"


def _buckets(t: Tables) -> DataFrame:
    return metrics.histogram(t.metrics, ["outcome"], "seconds", BOUNDS)


@query("WITH " + BUCKETS.replace("v(le)", "v(le0)").replace("le,", "CAST(le0 AS DOUBLE) AS le,").replace("seconds <= le)", "seconds <= le0)") + " SELECT outcome, CASE WHEN le > 1000 THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, n FROM buckets", "metrics")
def latency_histogram(t: Tables) -> DataFrame:
    return _buckets(t).withColumn("le", F.when(F.col("le") > 1000, "+Inf").otherwise(F.col("le").cast("string")))


@query(
    "WITH "
    + BUCKETS.replace("v(le)", "v(le0)").replace("le,", "CAST(le0 AS DOUBLE) AS le,").replace("seconds <= le)", "seconds <= le0)")
    + """, b AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY outcome) AS total FROM buckets WINDOW w AS (PARTITION BY outcome ORDER BY le)),
    qs AS (SELECT unnest([0.5, 0.9, 0.99]) AS p),
    hit AS (SELECT outcome, p, le, low, n, before, total, row_number() OVER (PARTITION BY outcome, p ORDER BY le) AS r FROM b, qs WHERE n >= total * p)
    SELECT outcome, CAST(p AS DOUBLE) AS p, round(CASE WHEN le > 1000 THEN low ELSE low + (le - low) * (total * p - before) / (n - before) END, 9) AS q FROM hit WHERE r = 1""",
    "metrics",
)
def latency_quantiles(t: Tables) -> DataFrame:
    b = _buckets(t)
    out = None
    for p in (0.5, 0.9, 0.99):
        one = metrics.quantile(b, ["outcome"], p).select("outcome", F.lit(p).alias("p"), F.round("q", 9).alias("q"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT outcome, round(count(*) FILTER (WHERE seconds <= 1.0) / count(*), 12) AS share FROM metrics GROUP BY ALL", "metrics")
def share_within_bound(t: Tables) -> DataFrame:
    return metrics.share_at(_buckets(t), ["outcome"], 1.0).select("outcome", F.round("share", 12).alias("share"))


COUNTER = f"counter AS (SELECT tenant_id, ts, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY ts, id) % 37 AS DOUBLE) AS value FROM metrics)"


def _counter(t: Tables) -> DataFrame:
    """A counter that starts anew after every 37 events."""
    return t.metrics.select("tenant_id", "ts", (F.row_number().over(Window.partitionBy("tenant_id").orderBy("ts", "id")) % 37).cast("double").alias("value"))


#: The samples of ten days, what each gained, and a window's growth to its edges.
GROWN = f"""{COUNTER}, s AS (SELECT *, lag(value) OVER (PARTITION BY tenant_id ORDER BY ts) AS last FROM counter WHERE ts > {START + 5 * DAY} AND ts <= {START + 15 * DAY}),
e AS (SELECT tenant_id, sum(CASE WHEN last IS NULL THEN 0 WHEN value >= last THEN value - last ELSE value END) AS gain, arg_min(value, ts) AS v, CAST(min(ts) AS DOUBLE) AS a, CAST(max(ts) AS DOUBLE) AS b, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT *, (b - a) / (n - 1) AS mean, a - {START + 5 * DAY} AS head, {START + 15 * DAY} - b AS tail FROM e),
x AS (SELECT *, CASE WHEN head >= 1.1 * mean THEN mean / 2 ELSE head END AS lead_in, CASE WHEN tail >= 1.1 * mean THEN mean / 2 ELSE tail END AS lead_out FROM m),
grown AS (SELECT tenant_id, gain * (b - a + CASE WHEN gain > 0 AND (b - a) * v / gain < lead_in THEN (b - a) * v / gain ELSE lead_in END + lead_out) / (b - a) AS increase FROM x)"""


@query(f"WITH {GROWN} SELECT tenant_id, round(increase, 6) AS increase FROM grown", "metrics")
def counter_increase(t: Tables) -> DataFrame:
    return metrics.increase(_counter(t), ["tenant_id"], START + 5 * DAY, START + 15 * DAY).withColumn("increase", F.round("increase", 6))


@query(
    f"""WITH {GROWN}, r AS (SELECT tenant_id, increase / 864000.0 AS rate FROM grown)
    SELECT tenant_id % 5 AS grp, round(sum(rate), 12) AS rate, round(max(rate), 12) AS top, count(*) AS series FROM r GROUP BY ALL""",
    "metrics",
)
def rate_by_group(t: Tables) -> DataFrame:
    r = metrics.rate(_counter(t), ["tenant_id"], START + 5 * DAY, START + 15 * DAY)
    return r.groupBy((F.col("tenant_id") % 5).alias("grp")).agg(F.round(F.sum("rate"), 12).alias("rate"), F.round(F.max("rate"), 12).alias("top"), F.count("*").alias("series"))


@query(
    f"""WITH a AS (SELECT tenant_id, count(*) AS x FROM metrics WHERE ts < {START + 10 * DAY} GROUP BY ALL), b AS (SELECT tenant_id, count(*) AS y FROM metrics WHERE outcome = 'click' AND ts >= {START + 10 * DAY} GROUP BY ALL HAVING max(seconds) > 4.8)
    SELECT '/' AS op, tenant_id, round(x / y, 12) AS value FROM a JOIN b USING (tenant_id) UNION ALL SELECT '>', tenant_id, CAST(x AS DOUBLE) FROM a JOIN b USING (tenant_id) WHERE x > y
    UNION ALL SELECT 'and', tenant_id, CAST(x AS DOUBLE) FROM a SEMI JOIN b USING (tenant_id) UNION ALL SELECT 'unless', tenant_id, CAST(x AS DOUBLE) FROM a ANTI JOIN b USING (tenant_id)""",
    "metrics",
)
def vector_matching(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy("tenant_id").agg(F.count("*").cast("double").alias("value"))
    a = count(t.metrics.where(F.col("ts") < START + 10 * DAY))
    late = t.metrics.where((F.col("outcome") == "click") & (F.col("ts") >= START + 10 * DAY))
    b = late.groupBy("tenant_id").agg(F.count("*").cast("double").alias("value"), F.max("seconds").alias("top")).where("top > 4.8").drop("top")
    out = None
    for op in ("/", ">", "and", "unless"):
        one = metrics.vector(a, b, ["tenant_id"], op).select(F.lit(op).alias("op"), "tenant_id", F.round("value", 12).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH s AS (SELECT tenant_id, ts, seconds > 1.0 AS hot, sum(CAST(seconds <= 1.0 AS INT)) OVER (PARTITION BY tenant_id ORDER BY ts) AS island FROM metrics),
    f AS (SELECT *, CASE WHEN hot THEN min(CASE WHEN hot THEN ts END) OVER (PARTITION BY tenant_id, island) END AS since FROM s)
    SELECT tenant_id, count(*) FILTER (WHERE hot) AS true_at, count(*) FILTER (WHERE hot AND ts - since >= {6 * HOUR}) AS firing_at, min(CASE WHEN hot AND ts - since >= {6 * HOUR} THEN ts END) AS first_fired FROM f GROUP BY ALL""",
    "metrics",
)
def alert_for(t: Tables) -> DataFrame:
    held = metrics.held_for(t.metrics.select("tenant_id", "ts", "seconds"), ["tenant_id"], F.col("seconds") > 1.0, 6 * HOUR)
    return held.groupBy("tenant_id").agg(F.count("since").alias("true_at"), F.count_if("firing").alias("firing_at"), F.min(F.when(F.col("firing"), F.col("ts"))).alias("first_fired"))


@query(
    "SELECT coalesce((SELECT count(*) FILTER (WHERE regexp_full_match(outcome, 'err.*')) / count(*) FROM metrics WHERE outcome = 'absent' HAVING count(*) > 0), 0.0) AS absent, (SELECT round(count(*) FILTER (WHERE regexp_full_match(outcome, 'c.*|p.*')) / count(*), 12) FROM metrics) AS present",
    "metrics",
)
def error_ratio(t: Tables) -> DataFrame:
    """A ratio under an anchored label pattern; 0 where no series is."""
    ratio = lambda df, p: df.agg(F.count_if(F.col("outcome").rlike(f"^(?:{p})$")).alias("bad"), F.count("*").alias("n")).where("n > 0").select((F.col("bad") / F.col("n")).alias("value"))
    absent = metrics.or_zero(ratio(t.metrics.where("outcome = 'absent'"), "err.*"), t.spark).select(F.col("value").alias("absent"))
    present = metrics.or_zero(ratio(t.metrics, "c.*|p.*"), t.spark).select(F.round("value", 12).alias("present"))
    return absent.join(present, F.lit(True))


@query(
    f"""SELECT outcome, tenant_id % 3 AS grp, CAST(sum(CASE WHEN ts >= {START + 15 * DAY} THEN 1 ELSE -1 END) AS DOUBLE) AS change FROM metrics GROUP BY ALL""",
    "metrics",
)
def snapshot_change(t: Tables) -> DataFrame:
    """What a counter gained between two snapshots, series that one of them lacks counted as 0 there."""
    snap = lambda df: df.groupBy("outcome", (F.col("tenant_id") % 3).alias("grp"), "tenant_id").agg(F.count("*").cast("double").alias("value"))
    rows = t.metrics
    return metrics.change(snap(rows.where(F.col("ts") < START + 15 * DAY)), snap(rows.where(F.col("ts") >= START + 15 * DAY)), ["outcome", "grp"])


@query(
    """WITH m AS (SELECT 'fast' AS name, (SELECT count(*) FILTER (WHERE seconds <= 2.0) / count(*) FROM metrics) AS value, 0.5 AS floor UNION ALL SELECT 'fastest', (SELECT count(*) FILTER (WHERE seconds <= 0.1) / count(*) FROM metrics), 0.5 UNION ALL SELECT 'none', NULL, 0.99)
    SELECT name, coalesce(value >= floor, false) AS passed FROM m""",
    "metrics",
)
def gate_checks(t: Tables) -> DataFrame:
    b = metrics.histogram(t.metrics.select(F.lit(1).alias("one"), "seconds"), ["one"], "seconds", (0.1, 2.0))
    share = lambda name, bound, floor: metrics.share_at(b, ["one"], bound).select(F.lit(name).alias("name"), F.col("share").alias("value"), F.lit(floor).alias("floor"))
    return metrics.checks(share("fast", 2.0, 0.5).unionByName(share("fastest", 0.1, 0.5)).unionByName(share("none", 0.7, 0.99))).select("name", "passed")


@query(
    "SELECT n, CASE WHEN (n * 37) % 100 < 2 THEN 'CRITICAL' WHEN (n * 37) % 100 < 12 THEN 'HIGH' WHEN (n * 37) % 100 < 80 THEN 'NORMAL' ELSE 'LOW' END AS priority FROM range(0, 1000) t(n)",
)
def load_mix(t: Tables) -> DataFrame:
    """The load generator's priorities."""
    n = (F.col("id") * 37) % 100
    return t.spark.range(1000).select(F.col("id").alias("n"), F.when(n < 2, "CRITICAL").when(n < 12, "HIGH").when(n < 80, "NORMAL").otherwise("LOW").alias("priority"))


@query(
    f"""SELECT id, greatest(0, least(least({NOW} - run_at, {NOW} - coalesce(attempt_started_at, run_at)), {NOW} - CASE WHEN id % 4 = 1 THEN {NOW} - id % 90 * 1000000 ELSE run_at END)) / 1000000 AS latency, CAST(floor({NOW} / 60000000.0) - floor(run_at / 60000000.0) AS BIGINT) AS minutes FROM jobs WHERE state IN ('READY', 'RUNNING')""",
    "jobs",
)
def dispatch_latency(t: Tables) -> DataFrame:
    """Three instants hold a job back; where one is unknown, it does not."""
    freed = F.when(F.col("id") % 4 == 1, F.lit(NOW) - F.col("id") % 90 * 1_000_000)
    wait = metrics.dispatch_latency(F.col("run_at"), F.lit(NOW), F.col("attempt_started_at"), freed)
    return t.jobs.where("state in ('READY', 'RUNNING')").select("id", (wait / 1_000_000).alias("latency"), metrics.minute_boundaries(F.col("run_at"), F.lit(NOW)).alias("minutes"))


@query(
    " UNION ALL ".join(f"SELECT '{name}' AS family, outcome, {b} AS le, count(*) FILTER (WHERE seconds * {scale} <= {b}) AS n FROM metrics GROUP BY outcome" for name, scale, bounds in (("wait", 900.0, metrics.WAIT), ("duration", 60.0, metrics.DURATION), ("db", 0.2, metrics.DATABASE), ("latency", 5.0, metrics.LATENCY)) for b in bounds),
    "metrics",
)
def histogram_families(t: Tables) -> DataFrame:
    """The finite buckets of every family of histograms."""
    out = None
    for name, scale, bounds in (("wait", 900.0, metrics.WAIT), ("duration", 60.0, metrics.DURATION), ("db", 0.2, metrics.DATABASE), ("latency", 5.0, metrics.LATENCY)):
        one = metrics.histogram(t.metrics.withColumn("seconds", F.col("seconds") * scale), ["outcome"], "seconds", bounds).where(F.col("le") < metrics.INFINITE).select(F.lit(name).alias("family"), "outcome", "le", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT state, tenant_id, job_type, count(*) AS jobs, count(*) FILTER (WHERE state = 'RETRY_PENDING') AS retried, count(*) FILTER (WHERE state = 'DEAD_LETTERED') AS dead FROM all_jobs GROUP BY ALL""",
    "all_jobs",
)
def job_counters(t: Tables) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("state") == s)
    return t.all_jobs.groupBy("state", "tenant_id", "job_type").agg(F.count("*").alias("jobs"), is_("RETRY_PENDING").alias("retried"), is_("DEAD_LETTERED").alias("dead"))


@query("SELECT session_id, state, count(*) AS n, CAST(sum(finished_at - started_at) AS BIGINT) AS busy FROM attempts GROUP BY ALL", "attempts")
def attempt_counters(t: Tables) -> DataFrame:
    return t.attempts.groupBy("session_id", "state").agg(F.count("*").alias("n"), F.sum(F.col("finished_at") - F.col("started_at")).alias("busy"))


@query(f"SELECT CAST(floor((ts - {START}) / {10.0 * 60_000_000}) AS BIGINT) AS slot, outcome, count(*) AS n, max(seconds) AS top FROM metrics GROUP BY ALL", "metrics")
def rollup_windows(t: Tables) -> DataFrame:
    """Ten-minute windows; the streaming rollup gives the same."""
    return t.metrics.groupBy(F.floor((F.col("ts") - START) / (10 * 60_000_000)).cast("long").alias("slot"), "outcome").agg(F.count("*").alias("n"), F.max("seconds").alias("top"))
