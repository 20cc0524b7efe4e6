"""Dispatch rounds, alert rules, history partitions and changes on literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import alerts, changes, rounds
from quillon.sources import history

S = 1_000_000
MIN = 60 * S
T0 = 1_700_000_000 * S
SAMPLE = "name string, labels map<string,string>, ts long, value double"


def series(name, labels, step, values):
    return [(name, labels, T0 + i * step, float(v)) for i, v in enumerate(values)]


def firing(spark, rows, step, at, alert):
    out = alerts.evaluate(spark.createDataFrame(rows, SAMPLE), T0, T0 + at, step, tuple(r for r in alerts.RULES if r.name == alert))
    return {tuple(sorted(r["labels"].items())): r["value"] for r in out.where((F.col("at") == T0 + at) & F.col("firing")).collect()}


def test_dispatch_stalled(spark):
    rows = []
    for pool in ("stuck", "busy"):
        rows += series("jobs_ready", {"pool": pool, "priority": "NORMAL"}, 30 * S, [5] * 11)
        rows += series("worker_slots", {"pool": pool, "state": "free"}, 30 * S, [3] * 11)
    rows += series("dispatch_latency_seconds_count", {"pool": "busy", "priority": "NORMAL"}, 30 * S, range(0, 22, 2))
    assert set(firing(spark, rows, 30 * S, 4 * MIN, "DispatchStalled")) == {(("pool", "stuck"),)}


def test_backlog_age(spark):
    rows = []
    for pool, target in (("web", 300), ("batch", 3600)):
        rows += series("jobs_oldest_ready_age_seconds", {"pool": pool, "instance": "a"}, MIN, [400] * 16)
        rows += series("pool_backlog_target_seconds", {"pool": pool, "instance": "a"}, MIN, [target] * 16)
    assert firing(spark, rows, MIN, 5 * MIN, "BacklogAge") == {}
    assert firing(spark, rows, MIN, 11 * MIN, "BacklogAge") == {(("pool", "web"),): 400.0}


def test_no_pool_owner(spark):
    rows = [r for i in "ab" for r in series("pools_unowned", {"instance": i}, 15 * S, [0, 0, 1, 1, 1, 1])]
    assert firing(spark, rows, 15 * S, 30 * S, "NoPoolOwner") == {}
    assert firing(spark, rows, 15 * S, 75 * S, "NoPoolOwner") == {(): 1.0}


def test_scheduling_lag(spark):
    rows = []
    for le, by in (("1", 1), ("2.5", 100), ("+Inf", 100)):
        rows += series("scheduling_lag_seconds_bucket", {"pool": "slow", "le": le}, MIN, range(0, 21 * by, by))
    got = firing(spark, rows, MIN, 16 * MIN, "SchedulingLagSLO")
    assert got[(("pool", "slow"),)] == pytest.approx(2.4848, abs=1e-3)


def test_api_errors(spark):
    rows = []
    for code, by in (("200", 950), ("503", 50)):
        rows += series("http_server_request_duration_seconds_count", {"server_address": "api", "http_response_status_code": code}, MIN, range(0, 16 * by, by))
    assert firing(spark, rows, MIN, 12 * MIN, "APIErrors")[()] == pytest.approx(0.05)


def test_other_rules(spark):
    rows = series("worker_sessions_expired_total", {"pool": "p"}, MIN, range(0, 33, 3)) + series("db_clock_offset_seconds", {"instance": "a"}, MIN, [-0.7] * 11)
    rows += series("db_pool_in_use", {"instance": "a", "role": "r"}, MIN, [19] * 11) + series("db_pool_max", {"instance": "a", "role": "r"}, MIN, [20] * 11)
    rows += series("stale_completions_rejected_total", {"pool": "p"}, MIN, range(11)) + series("jobs_dead_lettered_total", {"type": "t"}, MIN, [0] * 5 + [20] * 6)
    assert firing(spark, rows, MIN, 10 * MIN, "SessionExpirySpike") == {(("pool", "p"),): 15.0}
    assert firing(spark, rows, MIN, 10 * MIN, "ClockOffset") == {(("instance", "a"),): 0.7}
    assert firing(spark, rows, MIN, 10 * MIN, "DatabaseConnectionsSaturated") == {(("instance", "a"), ("role", "r")): 0.95}
    assert firing(spark, rows, MIN, 10 * MIN, "ZombieReports") == {(("pool", "p"),): 10.0}
    assert set(firing(spark, rows, MIN, 10 * MIN, "DeadLetterSpike")) == {(("type", "t"),)}


def test_alert_over_many_hours(spark):
    rows = series("pools_unowned", {"instance": "a"}, 10 * MIN, [1] * 40)
    assert firing(spark, rows, 10 * MIN, 380 * MIN, "NoPoolOwner") == {(): 1.0}


def plain_growth(samples, at, span):
    """A window's growth by walking through its samples."""
    own = [(t, v) for t, v in sorted(samples) if at - span < t <= at]
    if len(own) < 2 or own[0][0] == own[-1][0]:
        return None
    gain = sum(b - a if b >= a else b for (_, a), (_, b) in zip(own, own[1:]))
    covered, mean = own[-1][0] - own[0][0], (own[-1][0] - own[0][0]) / (len(own) - 1)
    head, tail = own[0][0] - (at - span), at - own[-1][0]
    head, tail = (mean / 2 if x >= 1.1 * mean else x for x in (head, tail))
    if gain > 0:
        head = min(head, covered * own[0][1] / gain)
    return gain * (covered + head + tail) / covered


def test_vectors_equal_the_walk(spark):
    rng = random.Random(5)
    rows, series_ = [], {}
    for k in range(6):
        t, v = rng.randint(0, 90), 0.0
        while t < 3_000:
            rows.append(("c", {"s": str(k), "pool": str(k % 2)}, T0 + t * S, v))
            series_.setdefault(k, []).append((T0 + t * S, v))
            t += rng.choice([5, 15, 40, 400])
            v = v + rng.randint(0, 9) if rng.random() > 0.1 else float(rng.randint(0, 3))
    step, until = 10 * S, T0 + 4_000 * S
    s = alerts.Samples(spark.createDataFrame(rows, SAMPLE), T0, until, step)
    for span in (2 * MIN, 20 * MIN):
        want = {}
        for at in range(T0, until + 1, step):
            for k, own in series_.items():
                if (g := plain_growth(own, at, span)) is not None:
                    want[(at, str(k % 2))] = want.get((at, str(k % 2)), 0.0) + g
        got = {(r["at"], r["pool"]): r["value"] for r in s.grown("c", ("pool",), span).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-6) for x in want)
    want = {}
    for at in range(T0, until + 1, step):
        for k, own in series_.items():
            if seen := [v for t, v in own if at - alerts.STALE < t <= at]:
                want.setdefault((at, str(k % 2)), []).append(seen[-1])
    got = {(r["at"], r["pool"]): r["value"] for r in s.instant("c", ("pool",), "max").collect()}
    assert got == {x: max(v) for x, v in want.items()}


def test_alert_rules_see_every_sample(spark, tmp_path):
    """One series over target at three scrapes on the 20th day, off the minute, and a last sample that is off the evaluations' grid."""
    from quillon.plans import registry
    from quillon.plans.observing import START

    late = START + 19 * 86_400 * S + 3 * S
    rows = [(1, START + S, 1, "web", 1.0), *((2 + i, late + i * 4 * MIN, 1, "web", 400.0) for i in range(3)), (9, START + 29 * 86_400 * S + 7 * S, 1, "api", 400.0)]
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double")
    events.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    out = registry.queries()["alert_rules"](spark, str(tmp_path)).where("alert = 'BacklogAge'").collect()
    web = sorted((r["at"], r["firing"]) for r in out if r["labels"]["pool"] == "web")
    first = late + 7 * S
    assert web == [(first + i * 10 * S, i * 10 >= 600) for i in range((8 + 5) * 6)]
    assert [r["at"] for r in out if r["labels"]["pool"] == "api"] == [START + 29 * 86_400 * S + 10 * S]


# -- rounds ------------------------------------------------------------------------------


def test_round_shares_slots():
    jobs = [(p, i, 100 * p + i, 1, 0) for p in (4, 1) for i in range(40)]
    got = rounds.serve(jobs, {}, [(1, 9, frozenset()), (2, 9, frozenset())])
    count = lambda s, p: sum(x[1] == s and x[2] == p for x in got)
    assert [count(s, p) for s in (1, 2) for p in (4, 1)] == [8, 1, 8, 1]
    assert len({x[0] for x in got}) == 18


def test_round_fills_what_a_class_lacks():
    jobs = [(4, 0, 1, 1, 0)] + [(2, i, 10 + i, 1, 0) for i in range(20)]
    got = rounds.serve(jobs, {}, [(1, 10, frozenset())])
    assert sum(x[2] == 4 for x in got) == 1 and sum(x[2] == 2 for x in got) == 9


def test_round_keeps_caps_and_types():
    jobs = [(2, i, i, 1, 0) for i in range(10)] + [(2, 50 + i, 50 + i, 2, 7) for i in range(3)]
    got = rounds.serve(jobs, {1: 2}, [(1, 4, frozenset({7})), (2, 10, frozenset())])
    assert [x[0] for x in got if x[1] == 1] == [50, 51, 52]
    assert sorted(x[0] for x in got if x[1] == 2) == [0, 1]
    assert rounds.serve(jobs, {1: 0, 2: 0}, [(1, 4, frozenset())]) == []


def plain_round(jobs, caps, waiters):
    """The round over one list, with nothing kept between claims but what the rules name."""
    left, waiting, shut, credits, out = dict(caps), sorted(jobs), set(), {4: 0, 3: 0, 2: 0, 1: 0}, []
    weight = {4: 8, 3: 4, 2: 2, 1: 1}

    def claim(types, p, n):
        window = [j for j in waiting if j[0] == p and left.get(j[3], 1) > 0 and (not types or j[4] in types)][: min(4 * n, max(n, 1000))]
        fair = [j for i, j in enumerate(window) if sum(k[3] == j[3] for k in window[:i]) < left.get(j[3], len(jobs))][:n]
        for j in fair:
            waiting.remove(j)
            if j[3] in left:
                left[j[3]] -= 1
        if len(fair) < n:
            shut.add((types, p))
        return [(j[2], p) for j in fair]

    for session, slots, types in waiters:
        is_open = lambda p: not {(types, p), (frozenset(), p)} & shut and any(j[0] == p for j in jobs)  # noqa: B023, E731
        want = []
        if any(is_open(p) for p in weight):
            for _ in range(slots):
                there = [p for p in weight if is_open(p)]
                for p in there:
                    credits[p] += weight[p]
                best = max(there, key=lambda p: (credits[p], p))
                credits[best] -= sum(weight[p] for p in there)
                want.append(best)
        got = [x for p in weight if p in want for x in claim(types, p, want.count(p))]
        for p in weight:
            if is_open(p) and len(got) < slots:
                got += claim(types, p, slots - len(got))
        out += [(id_, session, p, i) for i, (id_, p) in enumerate(got)]
    return out


def test_round_equals_the_plain_round():
    rng = random.Random(11)
    for _ in range(150):
        jobs = [(rng.randint(1, 4), rng.randint(0, 9), i, rng.randint(1, 4), rng.randint(0, 2)) for i in range(rng.randint(0, 90))]
        caps = {1: rng.randint(0, 5), 2: rng.randint(0, 40)}
        waiters = [(s, rng.randint(1, 8), frozenset(rng.sample([0, 1, 2], rng.randint(0, 2)))) for s in range(6)]
        got = rounds.serve(jobs, caps, waiters)
        assert got == plain_round(jobs, caps, waiters)
        by = {j[2]: j for j in jobs}
        assert len({x[0] for x in got}) == len(got)
        assert all(sum(by[x[0]][3] == t for x in got) <= n for t, n in caps.items())
        for s, n, types in waiters:
            own = [x for x in got if x[1] == s]
            assert len(own) <= n and all(not types or by[x[0]][4] in types for x in own)


def test_selector_remembers_earlier_rounds():
    jobs = [(p, i, 100 * p + i, 1, 0) for p in (4, 3, 2, 1) for i in range(40)]
    credits = {4: 0, 3: 0, 2: 0, 1: 0}
    turns = [rounds.serve(jobs, {}, [(1, 1, frozenset())], credits)[0][2] for _ in range(15)]
    assert [turns.count(p) for p in (4, 3, 2, 1)] == [8, 4, 2, 1] and set(credits.values()) == {0}


def test_dispatch_round_equals_the_plain_round(spark, sf):
    """The registered query, whole, against the plain round over the same tables."""
    from quillon.operators import dispatch
    from quillon.plans import registry
    from quillon.sources.views import NOW

    t = registry.Tables(spark, sf)
    ready = dispatch.open_to_claims(t.jobs, t.tenants, t.job_types, t.pools, NOW).collect()
    sessions = t.worker_sessions.where("state = 'ACTIVE' and not draining").collect()
    want = set()
    for pool in {r["pool"] for r in ready}:
        own = [r for r in ready if r["pool"] == pool]
        queue = [(s["id"], s["slots"], frozenset((0, 2)) if s["id"] % 3 == 0 else frozenset()) for s in sorted(sessions, key=lambda s: (s["id"] % 17, s["id"])) if s["pool"] == pool]
        caps = {r["tenant_id"]: r["allowance"] for r in own if r["allowance"] is not None}
        want |= {(pool, *x) for x in plain_round([(r["priority"], r["run_at"], r["id"], r["tenant_id"], r["job_type"]) for r in own], caps, queue)}
    got = {(r["pool"], r["id"], r["session_id"], r["priority"], r["nth"]) for r in registry.queries()["dispatch_round"](spark, sf).collect()}
    assert got == want and len(got) > 20


def test_selectors_go_on_from_their_memory(spark):
    tenants = spark.createDataFrame([(1, None)], "id int, max_running int")
    types = spark.createDataFrame([(1, 0, False, True)], "tenant_id int, name int, paused boolean, enabled boolean")
    pools = spark.createDataFrame([("a", False), ("b", False), ("idle", False)], "name string, paused boolean")
    rows = [(n, 1, 0, pool, "READY", 1 + n % 4, T0 - n) for n, pool in enumerate(["a"] * 40 + ["b"] * 40)]
    jobs = spark.createDataFrame(rows, "id long, tenant_id int, job_type int, pool string, state string, priority int, run_at long")
    jobs = jobs.selectExpr("*", "cast(null as long) as start_deadline", "cast(null as long) as deadline", "cast(null as long) as cancel_requested_at", "0 as attempt_count")
    waiters = spark.createDataFrame([("a", 1, 0, 3, []), ("a", 2, 1, 4, []), ("b", 3, 0, 5, [])], "pool string, session_id long, arrived int, slots int, types array<int>")
    memory = spark.createDataFrame([("idle", 4, 9)], "pool string, priority int, credit long")
    credits, started = {p: dict.fromkeys((4, 3, 2, 1), 0) for p in "ab"}, set()
    for _ in range(3):
        plan = rounds.round_with_memory(jobs.where(~F.col("id").isin(*started)) if started else jobs, waiters, tenants, types, pools, T0, memory).collect()
        plan = spark.createDataFrame(plan, rounds.ROUND)
        want = set()
        for pool, queue in (("a", [(1, 3, frozenset()), (2, 4, frozenset())]), ("b", [(3, 5, frozenset())])):
            left = [(p, run_at, id_, 1, 0) for id_, _, _, where, _, p, run_at in rows if where == pool and id_ not in started]
            want |= {(pool, *r) for r in rounds.serve(left, {}, queue, credits[pool])}
        assert {tuple(r) for r in rounds.assigned(plan).collect()} == want and len(want) == 12
        memory = spark.createDataFrame(rounds.remembered(plan, memory).collect(), "pool string, priority int, credit long")
        assert {tuple(r) for r in memory.collect()} == {("idle", 4, 9)} | {(pool, p, c) for pool, own in credits.items() for p, c in own.items()}
        started |= {r[1] for r in want}
    assert any(c for own in credits.values() for c in own.values())


def test_selector_memory_query(spark, sf):
    """Each pool's credits sum to what they were, as every step pays what it gives, and move in pools that start jobs."""
    from quillon.plans import registry

    q = registry.queries()
    after, pools = {}, [r["name"] for r in registry.Tables(spark, sf).pools.collect()]
    for r in q["selector_memory"](spark, sf).collect():
        after.setdefault(r["pool"], {})[r["priority"]] = r["credit"]
    busy = {r["pool"] for r in q["dispatch_round"](spark, sf).collect()}
    start = {pool: {p: len(pool) * p % 7 - 3 for p in (4, 3, 2, 1)} for pool in pools}
    assert all(sum(after[p].values()) == sum(start[p].values()) for p in pools)
    assert busy and all((after[p] != start[p]) <= (p in busy) for p in pools) and any(after[p] != start[p] for p in busy)


def test_cap_memory(spark):
    from quillon.operators import dispatch

    memory = spark.createDataFrame([("a", 1, True, None), ("a", 2, True, 5), ("a", 3, False, 6), ("a", 4, True, 7)], "pool string, tenant_id int, at_cap boolean, freed_at long")
    now = spark.createDataFrame([("a", 1, 3), ("a", 2, 0), ("a", 3, 0), ("b", 1, 0), ("b", 2, 1)], "pool string, tenant_id int, allowance long")
    got = {(r[0], r[1]): (r[2], r[3]) for r in dispatch.cap_memory(memory, now, 99).collect()}
    assert got == {("a", 1): (False, 99), ("a", 2): (True, 5), ("a", 3): (True, 6), ("a", 4): (True, 7), ("b", 1): (True, None), ("b", 2): (False, None)}


# -- history, changes ----------------------------------------------------------------------


def test_history_partitions(spark, tmp_path):
    day = 86_400 * S
    first = T0 - T0 % day
    rows = spark.createDataFrame([(i, first + i * day + S) for i in range(5)] + [(99, None)], "id long, finished_at long")
    path = f"file://{tmp_path}/history"
    history.write(rows, path)
    assert len(history.partitions(spark, path)) == 5
    history.rewrite_days(spark.createDataFrame([(100, first + S)], "id long, finished_at long"), path)
    assert sorted(r["id"] for r in history.read(spark, path).collect()) == [1, 2, 3, 4, 99, 100]
    assert len(history.drop_before(spark, path, first + 2 * day + S)) == 2
    assert sorted(r["id"] for r in history.read(spark, path).collect()) == [2, 3, 4, 99]


def test_one_holder_gets_a_lease(spark):
    leases = spark.createDataFrame([("a", "x", 3, T0 - S), ("b", "y", 5, T0 + S)], "name string, holder string, epoch long, expires_at long")
    asks = spark.createDataFrame([("a", "p", 1), ("a", "q", 0), ("b", "p", 0), ("c", "p", 0)], "name string, holder string, arrived int")
    got = {(r["name"], r["holder"]): (r["granted"], r["epoch"]) for r in changes.acquire(leases, asks, T0, S).collect()}
    assert got == {("a", "q"): (True, 4), ("a", "p"): (False, None), ("b", "p"): (False, None), ("c", "p"): (True, 1)}


# -- the load gate -----------------------------------------------------------------------------


def test_gate(spark):
    from quillon.operators import gate

    kind = "name string, labels map<string,string>, value double"
    snap = lambda k: [
        ("jobs_submitted_total", {"tenant": "a"}, 600.0 * k), ("jobs_submitted_total", {"tenant": "b"}, 395.0 * k), ("dispatch_latency_seconds_count", {"node": "x"}, 990.0 * k),
        *(("dispatch_latency_seconds_bucket", {"le": le}, n * k) for le, n in (("0.5", 900.0), ("1", 985.0), ("+Inf", 990.0))),
        *(("queue_wait_seconds_bucket", {"le": le}, n * k) for le, n in (("0.1", 50.0), ("0.5", 90.0), ("1", 99.0), ("+Inf", 100.0))),
        ("jobs_completed_total", {"state": "SUCCEEDED", "type": "t"}, 900.0 * k), ("process_cpu_seconds_total", {"node": "api"}, 0.398 * k), ("db_transaction_duration_seconds_count", {"operation": "claim"}, 50.0 * k),
    ]
    before, after = (spark.createDataFrame(snap(k), kind) for k in (1, 2))
    out = gate.report(before, after, 10.0, 100.0)
    got = {(r["kind"], r["name"]): (r["value"], r["passed"]) for r in out.collect()}
    assert got[("check", "accepted rate")] == (pytest.approx(0.995), True)
    assert got[("check", "dispatch latency")] == (pytest.approx(985 / 990), True)
    assert got[("check", "dispatch keeps up")] == (pytest.approx(990 / 995), True)
    assert got[("queue wait", "p50")][0] == pytest.approx(0.1) and got[("queue wait", "p99")][0] == pytest.approx(1.0)
    assert got[("completed", "SUCCEEDED")][0] == 900 and got[("transactions a second", "claim")][0] == 5
    assert got[("CPU ms a job", "api")][0] == pytest.approx(0.4) and got[("vCPUs", "api")][0] == pytest.approx(0.04)
    assert gate.passed(out)
    cron = gate.report(before, after, 10.0, 0.0, schedules=10, boundaries=2)
    assert not gate.passed(cron) and {r["name"] for r in cron.where("kind = 'check'").collect()} == {"every fire promoted", "scheduling lag", "dispatch latency", "dispatch keeps up"}
