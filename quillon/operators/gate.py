"""The load gate: two snapshots of all nodes' series, and what a run's shares, rates and costs were between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import metrics

#: Floors of the checks.
FLOORS = {"accepted rate": 0.99, "every fire promoted": 0.99, "scheduling lag": 0.99, "dispatch latency": 0.99, "dispatch keeps up": 0.95}
BOUND = 1.0


def gains(before: DataFrame, after: DataFrame) -> DataFrame:
    """Series (name, labels, value) of two snapshots: name, le, label, gain. A counter's labels other than the one that its name is read by are summed."""
    by = {"jobs_completed_total": "state", "db_transaction_duration_seconds_count": "operation", "db_transaction_duration_seconds_bucket": "operation", "process_cpu_seconds_total": "node"}
    label = F.lit("")
    for name, key in by.items():
        label = F.when(F.col("name") == name, F.coalesce(F.col("labels")[key], F.lit(""))).otherwise(label)
    le = F.col("labels")["le"]
    bound = F.when(le == "+Inf", float("inf")).otherwise(le.try_cast("double"))
    flat = lambda df: df.select("name", F.coalesce(bound, F.lit(-1.0)).alias("le"), label.alias("label"), "value")
    return metrics.change(flat(before), flat(after), ["name", "le", "label"])


def report(before: DataFrame, after: DataFrame, seconds: float, offered: float, schedules: int = 0, boundaries: int = 0) -> DataFrame:
    """Rows (kind, name, value, floor, passed): the checks of a burst, or with ``schedules`` those of a cron run; then waits, ends, transactions and CPU per job."""
    g = gains(before, after)
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("change"))), F.lit(0.0))
    within = lambda name: F.sum(F.when((F.col("name") == name) & (F.col("le") == BOUND), F.col("change"))) / F.max(F.when(F.col("name") == name, F.col("change")))
    one = g.agg(
        total("jobs_submitted_total").alias("accepted"),
        total("dispatch_latency_seconds_count").alias("dispatched"),
        total("scheduling_lag_seconds_count").alias("promoted"),
        within("dispatch_latency_seconds_bucket").alias("latency"),
        within("scheduling_lag_seconds_bucket").alias("lag"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
    c = F.col
    if schedules:
        checks = {"every fire promoted": share(c("promoted"), F.lit(float(schedules * boundaries))), "scheduling lag": c("lag"), "dispatch latency": c("latency"), "dispatch keeps up": share(c("dispatched"), c("promoted"))}
    else:
        checks = {"accepted rate": share(c("accepted"), F.lit(offered * seconds)), "dispatch latency": c("latency"), "dispatch keeps up": share(c("dispatched"), c("accepted"))}
    rows = [F.struct(F.lit("check").alias("kind"), F.lit(n).alias("name"), F.coalesce(v, F.lit(float("nan"))).alias("value"), F.lit(FLOORS[n]).alias("floor")) for n, v in checks.items()]
    out = metrics.checks(one.select(F.inline(F.array(*rows))))

    extra = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("boolean").alias("passed"))
    jobs = one.select((c("promoted") if schedules else c("accepted")).alias("jobs"))  # one row
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        waits = metrics.quantile(g.where("name = 'queue_wait_seconds_bucket'").select(c("le"), F.lit("").alias("of"), c("change").alias("n")), ["of"], q)
        out = out.unionByName(extra(waits, "queue wait", F.lit(name), c("q")))
    out = out.unionByName(extra(g.where("name = 'jobs_completed_total'"), "completed", c("label"), c("change")))
    out = out.unionByName(extra(g.where("name = 'db_transaction_duration_seconds_count'"), "transactions a second", c("label"), c("change") / seconds))
    cpu = g.where("name = 'process_cpu_seconds_total'").join(jobs, F.lit(True)).where("jobs > 0")
    out = out.unionByName(extra(cpu, "CPU ms a job", c("label"), 1000 * c("change") / c("jobs")))
    return out if schedules else out.unionByName(extra(cpu, "vCPUs", c("label"), c("change") / c("jobs") * offered))


def passed(found: DataFrame) -> bool:
    """Whether every check holds."""
    return found.where("kind = 'check' and not passed").isEmpty()
