"""Handlers: user functions by job type, run over batches of claimed jobs, with typed outcomes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Handler = Callable[[dict], object]
OUTCOME = "id long, outcome string, retryable boolean, retry_after_ms long, result string, error string"


class Permanent(Exception):
    """A failure that no retry mends."""


class RetryAfter(Exception):
    """A failure to be retried after so many milliseconds."""

    def __init__(self, message: str, after_ms: int):
        super().__init__(message)
        self.after_ms = after_ms


def run_one(handlers: dict[str, Handler], job: dict, clock: Callable[[], float] = time.monotonic) -> dict:
    """The outcome of one job: what it returns, or how it failed. A handler that ran past its timeout has timed out, whatever it returned."""
    out = {"id": job["id"], "outcome": "SUCCEEDED", "retryable": None, "retry_after_ms": None, "result": None, "error": None}
    handler = handlers.get(job["job_type"])
    if handler is None:
        return out | {"outcome": "FAILED", "retryable": False, "error": f"no handler for {job['job_type']}"}
    began = clock()
    try:
        out["result"] = json.dumps(handler(job), sort_keys=True)
    except Permanent as e:
        out |= {"outcome": "FAILED", "retryable": False, "error": str(e)}
    except RetryAfter as e:
        out |= {"outcome": "FAILED", "retryable": True, "retry_after_ms": e.after_ms, "error": str(e)}
    except Exception as e:  # noqa: BLE001  whatever a handler raises is its job's failure, not the batch's
        out |= {"outcome": "FAILED", "retryable": True, "error": f"{type(e).__name__}: {e}"}
    timeout = job.get("timeout_ms")
    if timeout is not None and (clock() - began) * 1000 > timeout:
        out |= {"outcome": "TIMED_OUT", "retryable": True, "retry_after_ms": None, "result": None, "error": "timed out"}
    return out


def execute(jobs: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """jobs: id, job_type, payload, timeout_ms. Returns an outcome a job; batches stream through, nothing is gathered."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([run_one(handlers, {k: None if v is None or v != v else v for k, v in row.items()}) for row in pdf.to_dict("records")], columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"retry_after_ms": "Int64", "retryable": "boolean"})

    return jobs.select("id", "job_type", "payload", "timeout_ms").mapInPandas(run, OUTCOME)


def email_send(job: dict) -> object:
    """A demonstration: needs an address."""
    payload = json.loads(job["payload"] or "{}")
    if "to" not in payload:
        raise Permanent("payload needs to")
    return {"sent": payload["to"]}


def demo_sleep(job: dict, sleep: Callable[[float], None] = time.sleep) -> object:
    """A demonstration: takes as long as its payload says."""
    try:
        seconds = float(json.loads(job["payload"] or "").get("seconds", 0))
    except (ValueError, AttributeError, TypeError) as e:
        raise Permanent(f"payload: {e}") from e
    sleep(max(0.0, seconds))
    return {"slept": True}
