"""Alert rules over a long table of samples: name, labels (map), ts (microseconds), value.

A rule is evaluated at times ``step`` apart. At each time an instant vector takes
each series' latest sample of the last five minutes, a range one its growth over
the range. What holds at every evaluation for the rule's duration fires.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import metrics

SECOND = 1_000_000
MINUTE, DAY = 60 * SECOND, 86_400 * SECOND
STALE = 5 * MINUTE


@dataclass(frozen=True)
class Rule:
    name: str
    build: object  # (Samples) -> DataFrame: at, by..., value where the condition holds
    by: tuple[str, ...]
    hold: int = 0


class Samples:
    """Samples, and the times since, since + step, ... until at which rules are evaluated."""

    def __init__(self, samples: DataFrame, since: int, until: int, step: int):
        self.samples, self.since, self.until, self.step = samples, since, until, step

    def _at(self, s: DataFrame, start: Column, end: Column) -> DataFrame:
        """A row for each evaluation with start <= at < end: the times follow from the row, so nothing is joined."""
        behind = lambda x: (x - F.pmod(x - self.since, F.lit(self.step))).cast("long")  # noqa: E731  the evaluation at or before x
        first = F.greatest(F.lit(self.since), behind(start + (self.step - 1)))
        last = F.least(behind(F.lit(self.until)), behind(end - 1))
        s = s.withColumn("first_at", first).withColumn("last_at", last).where("first_at <= last_at")
        return s.withColumn("at", F.explode(F.sequence("first_at", "last_at", F.lit(self.step).cast("long")))).drop("first_at", "last_at")

    def _of(self, name: str, by: tuple[str, ...], where: Column | None) -> DataFrame:
        s = self.samples.where(F.col("name") == name)
        if where is not None:
            s = s.where(where)
        series = F.to_json(F.array_sort(F.map_entries("labels")))
        return s.select(series.alias("series"), *(F.coalesce(F.col("labels")[b], F.lit("")).alias(b) for b in by), "ts", "value")

    def instant(self, name: str, by: tuple[str, ...], agg: str = "sum", where: Column | None = None, of=None) -> DataFrame:
        """agg by labels over the latest samples: at, by..., value. A sample is the latest until the next one, or until it is stale."""
        s = self._of(name, by, where)
        then = F.lead("ts").over(Window.partitionBy("series", *by).orderBy("ts"))
        stale = F.col("ts") + STALE
        last = self._at(s.withColumn("then", then), F.col("ts"), F.least(stale, "then"))
        return last.groupBy("at", *by).agg(getattr(F, agg)(of(F.col("value")) if of else F.col("value")).alias("value"))

    def grown(self, name: str, by: tuple[str, ...], span: int, where: Column | None = None, rate: bool = False) -> DataFrame:
        """Sum by labels of what counters gained over the span before each time.

        Each series' gains are summed up once. A time's window is then two of these sums: that of the latest sample,
        and that of the first one after the window's start; either sample is known for a stretch of times at once.
        """
        s = self._of(name, by, where)
        w = Window.partitionBy("series", *by).orderBy("ts")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        s = s.withColumn("d", metrics.gained(F.col("value"), F.lag("value").over(w)))
        s = s.withColumns({"total": F.sum("d").over(upto), "nth": F.row_number().over(w), "then": F.lead("ts").over(w), "before": F.lag("ts").over(w)})
        gone = F.col("ts") + span
        on = ["series", *by, "at"]
        latest = self._at(s, F.col("ts"), F.least(gone, "then")).select(*on, F.col("ts").alias("last"), F.col("total").alias("to"), F.col("nth").alias("last_nth"))
        first = self._at(s, F.greatest(F.col("ts"), F.col("before") + span), gone).select(*on, F.col("ts").alias("first"), F.col("total").alias("from"), F.col("nth").alias("first_nth"), F.col("value").alias("first_value"))
        both = latest.join(first, on)
        gain = metrics.extrapolated(F.col("to") - F.col("from"), F.col("first_value"), F.col("first"), F.col("last"), F.col("last_nth") - F.col("first_nth") + 1, F.col("at") - span, F.col("at"))
        each = both.withColumn("gain", gain).where("gain is not null")
        total = F.sum("gain") / (span / SECOND) if rate else F.sum("gain")
        return each.groupBy("at", *by).agg(total.alias("value"))


def _lag_slo(s: Samples) -> DataFrame:
    b = s.grown("scheduling_lag_seconds_bucket", ("pool", "le"), 5 * MINUTE, rate=True)
    le = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").try_cast("double"))
    q = metrics.quantile(b.select("at", "pool", le.alias("le"), F.col("value").alias("n")), ["at", "pool"], 0.99)
    return q.where(~F.isnan("q") & (F.col("q") > 1)).select("at", "pool", F.col("q").alias("value"))


def _backlog(s: Samples) -> DataFrame:
    return metrics.vector(s.instant("jobs_oldest_ready_age_seconds", ("pool",), "max"), s.instant("pool_backlog_target_seconds", ("pool",), "max"), ["at", "pool"], ">")


def _stalled(s: Samples) -> DataFrame:
    ready = s.instant("jobs_ready", ("pool",)).where("value > 0")
    free = s.instant("worker_slots", ("pool",), where=F.col("labels")["state"] == "free").where("value > 0")
    moving = s.grown("dispatch_latency_seconds_count", ("pool",), 2 * MINUTE).where("value > 0")
    return metrics.vector(metrics.vector(ready, free, ["at", "pool"], "and"), moving, ["at", "pool"], "unless")


def _dead(s: Samples) -> DataFrame:
    now = s.grown("jobs_dead_lettered_total", ("type",), 10 * MINUTE, rate=True)
    usual = s.grown("jobs_dead_lettered_total", ("type",), DAY, rate=True).withColumn("value", 3 * F.col("value"))
    many = s.grown("jobs_dead_lettered_total", ("type",), 10 * MINUTE).where("value >= 10")
    return metrics.vector(metrics.vector(now, usual, ["at", "type"], ">"), many, ["at", "type"], "and")


def _api(s: Samples) -> DataFrame:
    api = F.col("labels")["server_address"] == "api"
    name = "http_server_request_duration_seconds_count"
    bad = s.grown(name, (), 5 * MINUTE, api & F.col("labels")["http_response_status_code"].rlike("^(?:5..)$"), rate=True)
    return metrics.vector(bad, s.grown(name, (), 5 * MINUTE, api, rate=True), ["at"], "/").where("value > 0.01")


def _connections(s: Samples) -> DataFrame:
    by = ("instance", "role")
    return metrics.vector(s.instant("db_pool_in_use", by, "max"), s.instant("db_pool_max", by, "max"), ["at", *by], "/").where("value > 0.9")


#: Thresholds, ranges and durations.
RULES = (
    Rule("SchedulingLagSLO", _lag_slo, ("pool",), 10 * MINUTE),
    Rule("BacklogAge", _backlog, ("pool",), 10 * MINUTE),
    Rule("DispatchStalled", _stalled, ("pool",), MINUTE),
    Rule("NoPoolOwner", lambda s: s.instant("pools_unowned", (), "max").where("value > 0"), (), 30 * SECOND),
    Rule("DeadLetterSpike", _dead, ("type",), 5 * MINUTE),
    Rule("SessionExpirySpike", lambda s: s.grown("worker_sessions_expired_total", ("pool",), 5 * MINUTE).where("value > 10"), ("pool",)),
    Rule("ZombieReports", lambda s: s.grown("stale_completions_rejected_total", ("pool",), 10 * MINUTE).where("value > 5"), ("pool",)),
    Rule("APIErrors", _api, (), 5 * MINUTE),
    Rule("DatabaseConnectionsSaturated", _connections, ("instance", "role"), 5 * MINUTE),
    Rule("ClockOffset", lambda s: s.instant("db_clock_offset_seconds", ("instance",), "max", of=F.abs).where("value > 0.5"), ("instance",), 5 * MINUTE),
)


def evaluate(samples: DataFrame, since: int, until: int, step: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Alerts: alert, at, labels, value, firing (else pending), for every evaluation in since..until."""
    out = None
    for rule in rules:
        held = rule.build(Samples(samples, since, until, step))
        # Evaluations without a gap: time minus place in the sequence is the same.
        key = list(rule.by)
        nth = F.row_number().over(Window.partitionBy(*(key or [F.lit(0)])).orderBy("at")).cast("long")
        held = held.withColumn("island", F.col("at") - nth * step)
        since_ = F.min("at").over(Window.partitionBy(*key, "island"))
        labels = F.map_from_arrays(F.array(*(F.lit(k) for k in key)), F.array(*(F.col(k) for k in key))) if key else F.create_map().cast("map<string,string>")
        one = held.select(F.lit(rule.name).alias("alert"), "at", labels.alias("labels"), "value", (F.col("at") - since_ >= rule.hold).alias("firing"))
        out = one if out is None else out.unionByName(one)
    return out
