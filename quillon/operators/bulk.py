"""Bulk operations: a tenant's jobs that a filter takes are cancelled or redriven a page at a time, newest first.

An operation has id, tenant_id, kind, state, created_at, a filter (only_state, job_type, schedule_id, team; null takes
any), a cursor (cursor_created_at, cursor_id: the last job handled; a new operation's is its creation with the greatest
id, so that it covers the jobs created before it), counts, consecutive_errors and last_error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions.text import truncate_utf8

from . import dispatch, states

#: Jobs of a page, batches in a row that may break before an operation has failed, bytes kept of an error.
PAGE, MOST_ERRORS, ERROR_BYTES = 100, 10, 1000
ACTIVE = ("SCHEDULED", "READY", "RUNNING", "RETRY_PENDING", "PAUSED")
FILTERS = {"only_state": "state", "job_type": "job_type", "schedule_id": "schedule_id", "team": "team"}
KEY = ["tenant_id", "dedupe_key"]


def next_open(operations: DataFrame, nodes: int = 1) -> DataFrame:
    """The oldest operations that are not done, one for each node that asks."""
    return operations.where(F.col("state").isin("PENDING", "RUNNING")).orderBy("created_at", "id").limit(nodes)


def page(operations: DataFrame, jobs: DataFrame, nodes: int = 1, size: int = PAGE) -> DataFrame:
    """The next jobs of each open operation with their place ``n``, and one more where there are more.

    At most ``nodes`` operations are broadcast, and each task keeps a page of each, so nothing but pages is shuffled.
    """
    wants = [F.col(f).alias(f"want_{c}") for f, c in FILTERS.items()]
    asked = next_open(operations, nodes).select(F.col("id").alias("operation_id"), F.col("tenant_id").alias("of_tenant"), "kind", "cursor_created_at", "cursor_id", *wants)
    older = (F.col("created_at") < F.col("cursor_created_at")) | ((F.col("created_at") == F.col("cursor_created_at")) & (F.col("id") < F.col("cursor_id")))
    taken = (F.col("tenant_id") == F.col("of_tenant")) & older & ((F.col("kind") != "cancel") | F.col("state").isin(*ACTIVE))
    for c in FILTERS.values():
        taken &= F.col(f"want_{c}").isNull() | (F.col(f"want_{c}") == F.col(c))
    found = jobs.join(F.broadcast(asked), taken).drop("of_tenant", "cursor_created_at", "cursor_id", *(f"want_{c}" for c in FILTERS.values()))
    return dispatch.first_of_each(found, ["operation_id"], [F.desc("created_at"), F.desc("id")], size + 1, "n")


def decide(found: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """Adds outcome to a page's jobs: succeeded, skipped (no longer fit, or already being cancelled), or failed (an active job, or one redriven before it, holds its dedupe key)."""
    asked = states.lifecycle(found.withColumn("action", F.when(F.col("kind") == "cancel", "cancel").otherwise("retry")), now)
    # a page is small: the active jobs meet its keys where they are
    held = jobs.where(F.col("state").isin(*ACTIVE)).join(F.broadcast(found.select(*KEY).distinct()), KEY, "left_semi").select(*KEY).distinct().withColumn("held", F.lit(True))
    redriven = F.col("result") == "READY"
    turn = F.row_number().over(Window.partitionBy(*KEY, "result").orderBy("operation_id", "n"))
    clash = redriven & F.col("dedupe_key").isNotNull() & (F.col("held").isNotNull() | (F.col("turn") > 1))
    outcome = (
        F.when((F.col("kind") == "cancel") & F.col("cancel_requested_at").isNotNull(), "skipped")
        .when(clash, "failed")
        .when(redriven | F.col("result").isin("CANCELLED", "REQUESTED"), "succeeded")
        .otherwise("skipped")
    )
    return asked.withColumn("turn", turn).join(F.broadcast(held), KEY, "left").withColumn("outcome", outcome).drop("turn", "held")


def advance(operations: DataFrame, decided: DataFrame, now: int, nodes: int = 1, size: int = PAGE) -> DataFrame:
    """The open operations after their batch. decided: the page's jobs with outcome and error.

    A batch ends before its first job with an error, with the cursor at the last one handled, and is tried again from
    there; errors in that many batches in a row fail the operation. One without a further page has succeeded.
    """
    on_page = F.col("n") <= size
    stop = F.min(F.when(on_page & F.col("error").isNotNull(), F.col("n"))).over(Window.partitionBy("operation_id"))
    done = decided.withColumn("stop", stop).withColumn("handled", on_page & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    count = lambda outcome: F.count_if(F.col("handled") & (F.col("outcome") == outcome)).alias(f"now_{outcome}")
    batch = done.groupBy(F.col("operation_id").alias("id")).agg(
        *(count(o) for o in ("succeeded", "skipped", "failed")),
        F.min(F.when(F.col("handled"), F.struct("created_at", "id"))).alias("last"),
        F.max(F.when(F.col("n") == F.col("stop"), F.col("error"))).alias("error"),
        (F.max("n") > size).alias("more"),
    )
    errors = F.when(F.col("error").isNotNull(), F.col("consecutive_errors") + 1).otherwise(0)
    over = F.when(errors >= MOST_ERRORS, "FAILED").when(F.col("error").isNotNull() | F.coalesce("more", F.lit(False)), "RUNNING").otherwise("SUCCEEDED")
    plus = lambda c: (F.col(c) + F.coalesce(f"now_{c}", F.lit(0))).cast("long").alias(c)
    return next_open(operations, nodes).join(batch, "id", "left").select(
        "id",
        over.alias("state"),
        F.coalesce("last.created_at", "cursor_created_at").alias("cursor_created_at"),
        F.coalesce("last.id", "cursor_id").alias("cursor_id"),
        *(plus(c) for c in ("succeeded", "skipped", "failed")),
        errors.cast("long").alias("consecutive_errors"),
        F.coalesce(truncate_utf8(F.col("error"), F.lit(ERROR_BYTES)), "last_error").alias("last_error"),
        F.when(over != "RUNNING", F.lit(now)).cast("long").alias("finished_at"),
    )


def run_batch(operations: DataFrame, jobs: DataFrame, now: int, nodes: int = 1, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(decided jobs, advanced operations) of one batch for each of the oldest open operations; jobs: with dedupe_key and error."""
    decided = decide(page(operations, jobs, nodes, size), jobs, now)
    return decided, advance(operations, decided, now, nodes, size)
