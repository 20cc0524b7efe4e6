"""Bulk operations, batch by batch, against a walk over the jobs."""

import random

import pytest

from quillon.operators import bulk

NOW = 1_000
OPERATION = "id long, tenant_id int, kind string, state string, only_state string, job_type int, schedule_id long, team string, created_at long, cursor_created_at long, cursor_id long, succeeded long, skipped long, failed long, consecutive_errors long, last_error string"
JOB = "id long, tenant_id int, state string, job_type int, schedule_id long, team string, created_at long, run_at long, cancel_requested_at long, dedupe_key string, error string"
STATES = ("SCHEDULED", "READY", "RUNNING", "RETRY_PENDING", "PAUSED", "SUCCEEDED", "FAILED", "DEAD_LETTERED", "CANCELLED")
LAST = 2**63 - 1


def operation(id, kind, tenant=1, state="PENDING", created_at=500, **more):
    new = {"only_state": None, "job_type": None, "schedule_id": None, "team": None, "cursor_created_at": created_at, "cursor_id": LAST, "succeeded": 0, "skipped": 0, "failed": 0, "consecutive_errors": 0, "last_error": None}
    return {"id": id, "tenant_id": tenant, "kind": kind, "state": state, "created_at": created_at} | new | more


def job(id, state, tenant=1, created_at=100, **more):
    new = {"job_type": 1, "schedule_id": None, "team": None, "run_at": 0, "cancel_requested_at": None, "dedupe_key": None, "error": None}
    return {"id": id, "tenant_id": tenant, "state": state, "created_at": created_at} | new | more


def run(spark, operations, jobs, nodes=1, size=100):
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    frame = lambda rows, s: spark.createDataFrame([tuple(r[c] for c in names(s)) for r in rows], s)
    decided, advanced = bulk.run_batch(frame(operations, OPERATION), frame(jobs, JOB), NOW, nodes, size)
    return {(r["operation_id"], r["id"]): r["outcome"] for r in decided.where(f"n <= {size}").collect()}, {r["id"]: r.asDict() for r in advanced.collect()}


def walk(op, jobs, size):
    """One batch of one operation, job after job."""
    op = dict(op)
    fits = [
        j for j in sorted(jobs, key=lambda j: (-j["created_at"], -j["id"]))
        if j["tenant_id"] == op["tenant_id"] and (j["created_at"], j["id"]) < (op["cursor_created_at"], op["cursor_id"])
        and (op["kind"] != "cancel" or j["state"] in bulk.ACTIVE)
        and all(op[f] is None or op[f] == j[c] for f, c in bulk.FILTERS.items())
    ]
    held = {j["dedupe_key"] for j in jobs if j["tenant_id"] == op["tenant_id"] and j["state"] in bulk.ACTIVE}
    broke = None
    for j in fits[:size]:
        if j["error"] is not None:
            broke = j["error"]
            break
        if op["kind"] == "cancel":
            what = "succeeded" if j["cancel_requested_at"] is None else "skipped"
        elif j["state"] not in ("FAILED", "DEAD_LETTERED"):
            what = "skipped"
        elif j["dedupe_key"] is not None and j["dedupe_key"] in held:
            what = "failed"
        else:
            what = "succeeded"
            held.add(j["dedupe_key"])
        op[what] += 1
        op["cursor_created_at"], op["cursor_id"] = j["created_at"], j["id"]
    op["consecutive_errors"] = op["consecutive_errors"] + 1 if broke else 0
    op["last_error"] = broke or op["last_error"]
    op["state"] = "FAILED" if op["consecutive_errors"] >= 10 else "RUNNING" if broke or len(fits) > size else "SUCCEEDED"
    op["finished_at"] = None if op["state"] == "RUNNING" else NOW
    return op


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    jobs = [
        job(i, rng.choice(STATES), rng.randrange(3), rng.randrange(40), job_type=rng.randrange(2), schedule_id=rng.choice([None, 7]), team=rng.choice([None, "a", "b"]),
            cancel_requested_at=rng.choice([None, None, 5]), dedupe_key=rng.choice([None, "x", "y", str(i // 4)]), error=f"job {i}" if rng.random() < 0.03 else None)
        for i in range(200)
    ]
    filters = [{}, {"only_state": "FAILED"}, {"job_type": 1}, {"schedule_id": 7}, {"team": "a"}]
    ops = [operation(t, rng.choice(["cancel", "redrive"]), t, rng.choice(["PENDING", "RUNNING"]), rng.randrange(20, 50), consecutive_errors=rng.choice([0, 9]), last_error="old", **rng.choice(filters)) for t in range(3)]
    _, first = run(spark, ops, jobs, nodes=3, size=9)
    want = {o["id"]: walk(o, jobs, 9) for o in ops}
    assert {i: {k: w[k] for k in first[i]} for i, w in want.items()} == first
    again = [want[o["id"]] for o in ops if want[o["id"]]["state"] == "RUNNING"]
    if again:
        _, second = run(spark, again, jobs, nodes=3, size=9)
        assert {o["id"]: {k: w[k] for k in second[o["id"]]} for o in again for w in [walk(o, jobs, 9)]} == second


def test_the_oldest_open_operation_goes_first(spark):
    ops = [operation(1, "cancel", created_at=30), operation(2, "cancel", created_at=20), operation(3, "cancel", created_at=10, state="SUCCEEDED")]
    decided, after = run(spark, ops, [job(5, "READY", created_at=1), job(6, "READY", created_at=25)])
    assert decided == {(2, 5): "succeeded"}  # job 6 came after the operation
    assert list(after) == [2] and after[2]["state"] == "SUCCEEDED" and after[2]["finished_at"] == NOW


def test_ten_errors_in_a_row(spark):
    jobs = [job(1, "READY"), job(2, "READY", error="é" * 700)]
    _, after = run(spark, [operation(1, "cancel", consecutive_errors=8)], jobs)
    assert (after[1]["state"], after[1]["consecutive_errors"], after[1]["succeeded"], after[1]["cursor_id"]) == ("RUNNING", 9, 0, LAST)
    assert after[1]["last_error"] == "é" * 500
    _, after = run(spark, [operation(1, "cancel", consecutive_errors=9)], jobs)
    assert after[1]["state"] == "FAILED" and after[1]["finished_at"] == NOW


def test_no_jobs_and_no_operations(spark):
    _, after = run(spark, [operation(1, "redrive", succeeded=4)], [])
    assert after[1]["state"] == "SUCCEEDED" and after[1]["succeeded"] == 4 and after[1]["cursor_id"] == LAST
    assert run(spark, [], [job(1, "READY")]) == ({}, {})
    assert run(spark, [operation(1, "cancel", state="FAILED")], [job(1, "READY")]) == ({}, {})


def test_equal_keys_in_one_page(spark):
    jobs = [job(1, "FAILED", dedupe_key="k"), job(2, "DEAD_LETTERED", dedupe_key="k"), job(3, "FAILED"), job(4, "SUCCEEDED", dedupe_key="k"), job(5, "FAILED", dedupe_key="h"), job(6, "PAUSED", dedupe_key="h")]
    decided, _ = run(spark, [operation(1, "redrive")], jobs)
    assert decided == {(1, 1): "failed", (1, 2): "succeeded", (1, 3): "succeeded", (1, 4): "skipped", (1, 5): "failed", (1, 6): "skipped"}
