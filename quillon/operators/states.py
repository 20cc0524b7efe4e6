"""State machines as edge tables, and what a user's action does to a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed values: (from, to, who may). The empty state is a job before it exists.
JOB_EDGES = (
    ("", "SCHEDULED", "api"),
    ("", "SCHEDULED", "materializer"),
    ("", "READY", "api"),
    ("SCHEDULED", "READY", "promoter"),
    ("RETRY_PENDING", "READY", "promoter"),
    ("READY", "RUNNING", "dispatcher"),
    ("RUNNING", "SUCCEEDED", "dispatcher"),
    ("RUNNING", "RETRY_PENDING", "dispatcher"),
    ("RUNNING", "RETRY_PENDING", "reaper"),
    ("RUNNING", "FAILED", "dispatcher"),
    ("RUNNING", "FAILED", "reaper"),
    ("RUNNING", "DEAD_LETTERED", "dispatcher"),
    ("RUNNING", "DEAD_LETTERED", "reaper"),
    ("RUNNING", "CANCELLED", "dispatcher"),
    ("RUNNING", "CANCELLED", "reaper"),
    ("SCHEDULED", "PAUSED", "api"),
    ("READY", "PAUSED", "api"),
    ("PAUSED", "SCHEDULED", "api"),
    ("SCHEDULED", "CANCELLED", "api"),
    ("READY", "CANCELLED", "api"),
    ("READY", "CANCELLED", "promoter"),
    ("PAUSED", "CANCELLED", "api"),
    ("RETRY_PENDING", "CANCELLED", "api"),
    ("RETRY_PENDING", "CANCELLED", "promoter"),
    ("SCHEDULED", "EXPIRED", "promoter"),
    ("SCHEDULED", "EXPIRED", "dispatcher"),
    ("READY", "EXPIRED", "promoter"),
    ("READY", "EXPIRED", "dispatcher"),
    ("SCHEDULED", "SKIPPED", "promoter"),
    ("FAILED", "READY", "api"),
    ("DEAD_LETTERED", "READY", "api"),
    ("RUNNING", "READY", "dispatcher"),
)
ATTEMPT_ENDS = ("SUCCEEDED", "FAILED", "CANCELLED", "TIMED_OUT", "LOST")
#: Ends of an attempt that the reaper may write too.
REAPER_ENDS = ("TIMED_OUT", "LOST")


def check(moves: DataFrame) -> DataFrame:
    """Adds allowed to moves (from_state, to_state, actor)."""
    edges = moves.sparkSession.createDataFrame(JOB_EDGES, "from_state string, to_state string, actor string").withColumn("known", F.lit(True))
    return moves.join(F.broadcast(edges), ["from_state", "to_state", "actor"], "left").withColumn("allowed", F.coalesce("known", F.lit(False))).drop("known")


def check_attempts(moves: DataFrame) -> DataFrame:
    """Adds allowed to attempts' moves: only a running attempt ends."""
    who = F.when(F.col("to_state").isin(*REAPER_ENDS), F.col("actor").isin("dispatcher", "reaper")).otherwise(F.col("actor") == "dispatcher")
    return moves.withColumn("allowed", (F.col("from_state") == "RUNNING") & F.col("to_state").isin(*ATTEMPT_ENDS) & who)


def lifecycle(jobs: DataFrame, now: int) -> DataFrame:
    """Adds result to jobs with an action: cancel, pause, resume, run_now or retry."""
    is_ = lambda a, *s: (F.col("action") == a) & F.col("state").isin(*s)
    asked = F.col("cancel_requested_at").isNotNull()
    result = (
        F.when(is_("cancel", "SCHEDULED", "READY", "PAUSED", "RETRY_PENDING"), "CANCELLED")
        .when(is_("cancel", "RUNNING") & ~asked, "REQUESTED")
        .when(is_("cancel", "CANCELLED", "RUNNING"), "UNCHANGED")
        .when(is_("pause", "SCHEDULED", "READY"), "PAUSED")
        .when(is_("resume", "PAUSED"), "SCHEDULED")
        .when(is_("run_now", "SCHEDULED", "RETRY_PENDING"), "DUE_NOW")
        .when(is_("retry", "FAILED", "DEAD_LETTERED"), "READY")
        .otherwise("CONFLICT")
    )
    return jobs.withColumn("result", result).withColumn("run_at", F.when(F.col("result") == "DUE_NOW", F.lit(now)).otherwise(F.col("run_at")))
