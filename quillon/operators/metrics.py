"""Metric series: histograms, rates, quantiles, vector matching, alert durations, and the load gate's evaluation.

A series table is long: ts (microseconds), label columns, value. ``increase``
follows counter resets, and what the samples of a window gained is extrapolated
to its edges: to an edge that is nearer than 1.1 times the samples' mean
distance, else by half that distance, and at the start not beyond the point where
the counter would have been 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SECOND = 1_000_000
#: Bucket bounds in seconds.
WAIT = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0, 3600.0, 10800.0, 43200.0, 86400.0)
DURATION = (0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 900.0, 3600.0)
DATABASE = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0)
LATENCY = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)
INFINITE = float("inf")


def histogram(df: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = LATENCY) -> DataFrame:
    """Cumulative buckets, one pass and one row a group before they are unfolded: by, le, n (le infinite: all)."""
    counts = df.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("total"))
    entries = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(INFINITE).alias("le"), F.col("total").alias("n"))]
    return counts.select(*by, F.inline(F.array(*entries)))


def quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Linear interpolation within the bucket that holds the rank; beyond the last finite bound that bound; no values: not a number."""
    w = Window.partitionBy(*by).orderBy("le")
    b = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    b = b.withColumn("total", F.max("n").over(Window.partitionBy(*by))).withColumn("rank", F.col("total") * q)
    at = F.when(F.col("le") == INFINITE, F.col("low")).when(F.col("n") == F.col("before"), F.col("le")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before")))
    first = b.where((F.col("n") >= F.col("rank")) & (F.col("total") > 0)).groupBy(*by).agg(F.min_by(at, "le").alias("q"))
    return buckets.select(*by).distinct().join(first, by, "left").withColumn("q", F.coalesce("q", F.lit(float("nan"))))


def share_at(buckets: DataFrame, by: list[str], bound: float) -> DataFrame:
    """The share of values within a bound that is one of the buckets', else not a number."""
    g = buckets.groupBy(*by).agg(F.max(F.when(F.col("le") == bound, F.col("n"))).alias("n"), F.max("n").alias("total"))
    return g.select(*by, F.when(F.col("n").isNull() | (F.col("total") == 0), float("nan")).otherwise(F.col("n") / F.col("total")).alias("share"))


def gained(value: Column, last: Column) -> Column:
    """From the sample before; after a reset a counter has gained what it shows."""
    return F.when(last.isNull(), 0.0).when(value >= last, value - last).otherwise(value)


def extrapolated(gain: Column, first_value: Column, first: Column, last: Column, n: Column, since: Column, until: Column) -> Column:
    """What n samples between two instants gained, carried on to the window's edges; null for fewer than two."""
    covered = (last - first).cast("double")
    mean = covered / (n - 1)
    near = lambda gap: F.when(gap >= 1.1 * mean, mean / 2).otherwise(gap)
    before = near((first - since).cast("double"))
    before = F.when((gain > 0) & (first_value >= 0), F.least(before, covered * first_value / F.when(gain > 0, gain))).otherwise(before)
    return F.when((n > 1) & (covered > 0), gain * (covered + before + near((until - last).cast("double"))) / F.when(covered > 0, covered))


def increase(samples: DataFrame, series: list[str], since: int, until: int) -> DataFrame:
    """Growth of each counter over (since, until], resets taken as starts from 0; series with fewer than two samples there have none."""
    w = Window.partitionBy(*series).orderBy("ts")
    s = samples.where((F.col("ts") > since) & (F.col("ts") <= until)).withColumn("d", gained(F.col("value"), F.lag("value").over(w)))
    g = s.groupBy(*series).agg(F.sum("d").alias("gain"), F.min_by("value", "ts").alias("first_value"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    out = g.select(*series, extrapolated(F.col("gain"), F.col("first_value"), F.col("first"), F.col("last"), F.col("n"), F.lit(since), F.lit(until)).alias("increase"))
    return out.where("increase is not null")


def rate(samples: DataFrame, series: list[str], since: int, until: int) -> DataFrame:
    return increase(samples, series, since, until).select(*series, (F.col("increase") / ((until - since) / SECOND)).alias("rate"))


def dispatch_latency(ready_at: Column, started_at: Column, polled_at: Column, cap_freed_at: Column) -> Column:
    """How long a job waited once a worker was free for it and its tenant's cap had room: from the latest of its ready time, the poll and the cap's freeing (null: was not at its cap); microseconds, never negative."""
    return F.greatest(F.lit(0), F.least(started_at - ready_at, started_at - polled_at, started_at - cap_freed_at))


def held_for(samples: DataFrame, series: list[str], condition: Column, duration: int) -> DataFrame:
    """Adds since (when the condition last became true) and firing (true at every evaluation for ``duration``)."""
    w = Window.partitionBy(*series).orderBy("ts")
    s = samples.withColumn("true", condition)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("island", F.sum((~F.col("true")).cast("int")).over(upto))
    since = F.when(F.col("true"), F.min(F.when(F.col("true"), F.col("ts"))).over(Window.partitionBy(*series, "island")))
    s = s.withColumn("since", since)
    return s.withColumn("firing", F.coalesce(F.col("true") & (F.col("ts") - F.col("since") >= duration), F.lit(False))).drop("true", "island")


def vector(a: DataFrame, b: DataFrame, on: list[str], op: str) -> DataFrame:
    """a op b on equal label sets: and, unless, /, >."""
    if op in ("and", "unless"):
        return a.join(b, on, "left_semi" if op == "and" else "left_anti")
    both = a.select(*on, F.col("value").alias("x")).join(b.select(*on, F.col("value").alias("y")), on)
    return both.where("x > y").select(*on, F.col("x").alias("value")) if op == ">" else both.select(*on, (F.col("x") / F.col("y")).alias("value"))


def or_zero(scalar: DataFrame, spark) -> DataFrame:
    """A one-row result, 0 where there is none."""
    return spark.range(1).select(F.lit(0.0).alias("zero")).join(scalar.select(F.col("value")), F.lit(True), "left").select(F.coalesce("value", "zero").alias("value"))


# -- the load gate ---------------------------------------------------------------


def change(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """What counters gained between two snapshots, summed over nodes; a series that one of them lacks counts as 0 there."""
    signed = after.select(*by, "value").unionByName(before.select(*by, (-F.col("value")).alias("value")))
    return signed.groupBy(*by).agg(F.sum("value").alias("change"))


def checks(measured: DataFrame) -> DataFrame:
    """measured: name, value, floor. A value that is not a number fails."""
    return measured.withColumn("passed", ~F.isnan("value") & F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))


def minute_boundaries(since: Column, until: Column) -> Column:
    """Whole minutes in (since, until]."""
    return (F.floor(until / (60 * SECOND)) - F.floor(since / (60 * SECOND))).cast("long")


def clock_offset(db_now: Column, start: Column, rtt: Column) -> Column:
    """How far a database's clock is ahead, its answer taken at the middle of the round trip; microseconds."""
    return db_now - (start + (rtt / 2).cast("long"))
