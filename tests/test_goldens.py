"""Scalar and stateful semantics on small literal inputs."""

import math
from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillon.functions import cron, hashing, text
from quillon.operators import admission, changes, dispatch, handlers, lists, metrics, rounds, scheduling, states
from quillon.sources import exposition
from quillon.streaming import streams

S = 1_000_000
MIN = 60 * S
DAY = 86_400 * S


def micros(when: str) -> int:
    at = datetime.fromisoformat(when)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


# -- cron ------------------------------------------------------------------------

#: Expressions of every form, tried in zones whose clocks jump by an hour, by half an hour, and not at all.
EXPRESSIONS = ("7 * * * *", "*/25 * * * *", "50 0-3 * * *", "20,40 22 * * FRI,SUN", "15/20 6 1-9/4 * ?", "0 5 31 * *", "0 18 12 APR,oct wed", "@weekly", "10,50 */7 ? 3-9/3 2-7", "59 23 29 2 *")
ZONES = ("UTC", "Europe/Paris", "America/St_Johns", "Australia/Lord_Howe", "Pacific/Apia")
REFUSED = ["   ", "1 2 3", "1 2 3 4 5 6 7", "61 1 * * *", "7 25 * * *", "0 0 32 * *", "0 0 1 0 *", "0 0 * * 9", "*/0 1 * * *", "9-3 * * * *", "1 1 31 2,4 *", "0 0 L-2 * *", "0 0 15W * *", "0 0 * * MON#2", "0 ? * * *", "@reboot", "0 0 * JANUARY *", "4,,6 * * * *", "*-9 * * * *", "5/ * * * *", "-1 * * * *", "0 0 * * SAT-SUN"]


@cache
def readings(zone, since, until):
    """(minute, wall-clock minutes that it shows for the first time): those that a gap leaves out belong to its end."""
    tz, out, shown = ZoneInfo(zone), [], None
    for minute in range(since // MIN, until // MIN + 1):
        now = datetime.fromtimestamp(minute * 60, timezone.utc).astimezone(tz).replace(tzinfo=None)
        new = [now] if shown is None else [shown + timedelta(minutes=i) for i in range(1, int((now - shown) / timedelta(minutes=1)) + 1)]
        shown = now if shown is None else max(shown, now)
        out.append((minute * MIN, new))
    return out


def clock_fires(expr, zone, since, until):
    """The rule, minute by minute."""
    fields = cron.parse(expr)
    has = lambda name, v: fields[name] >> v & 1

    def hit(r):
        if not (has("minute", r.minute) and has("hour", r.hour) and has("month", r.month)):
            return False
        dom, dow = has("dom", r.day), has("dow", r.isoweekday() % 7)
        return dom and dow if fields["any_dom"] or fields["any_dow"] else dom or dow

    return [at for at, new in readings(zone, since - 2 * DAY, until) if since < at <= until and any(map(hit, new))]


def expanded(spark, rows):
    """cron.fires of (expr, zone, after, until): a sorted list for each."""
    got = cron.fires(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, expr string, zone string, after long, until long")).collect()
    return [sorted(r["fire_time"] for r in got if r["id"] == i) for i in range(len(rows))]


SPANS = [("2024-03-08", 26), ("2023-09-27", 12), ("2024-10-25", 12)]


def test_cron_equals_the_clock(spark):
    rows = [(e, z, micros(s) + 61 * S, micros(s) + n * DAY) for e in EXPRESSIONS for z in ZONES for s, n in SPANS] + [(e, "Pacific/Apia", micros("2011-12-28"), micros("2012-01-02")) for e in EXPRESSIONS]
    for row, found in zip(rows, expanded(spark, rows), strict=True):
        expected = clock_fires(*row)
        assert found == expected, row
        own, at = cron.Cron(row[0], row[1]), row[2]
        for fire in expected:
            at = own.after(at)
            assert at == fire, row
        assert own.upto(row[3], 3, row[2] + 1) == expected[-3:] and own.upto(row[3], 10_000, row[2] + 1) == expected, row


def test_cron_seconds_and_years(spark):
    a = micros("2025-06-30T23:59:58")
    assert expanded(spark, [("*/4 59 23 * * *", "", a, a + 4 * S), ("58-59 * * * * *", None, a, a + 65 * S)]) == [[], [a + S, a + 60 * S, a + 61 * S]]
    assert cron.Cron("30 15 10 29 FEB *").after(a) == micros("2028-02-29T10:15:30")
    assert cron.Cron("0 0 29 2 *").after(micros("2096-02-29T00:00")) == micros("2104-02-29T00:00")
    assert cron.Cron("0 0 1 1 *").upto(a, 2, 0) == [micros("2024-01-01"), micros("2025-01-01")]


@pytest.mark.parametrize("expr", REFUSED)
def test_cron_refuses(expr):
    with pytest.raises(ValueError):
        cron.parse(expr)


def test_rows_that_cannot_fire(spark):
    rows = [("@hourly", "Mars/Base"), ("@hourly", "Local"), ("@hourly", None), ("x", "UTC"), (None, "UTC"), ("@hourly", "../etc/passwd"), ("@hourly", "")]
    df = spark.createDataFrame([(i, e, z, 0, 2 * 60 * MIN) for i, (e, z) in enumerate(rows)], "id int, expr string, zone string, after long, until long")
    assert sorted({r["id"] for r in cron.problems(df).collect()}) == [0, 1, 3, 4, 5]
    assert sorted((r["id"], r["fire_time"] // MIN) for r in cron.fires(df).collect()) == [(2, 60), (2, 120), (6, 60), (6, 120)]


# -- planning ----------------------------------------------------------------------

LIMITS = scheduling.Limits(lookahead=5 * MIN, misfire_threshold=90 * S, max_misfires=3)
T0 = 1_710_000_000 * S  # a whole minute
SCHEDULE = "id long, tenant_id int, job_type int, kind string, misfire string, every long, expr string, zone string, next_fire_at long, end_at long, max_runs int, fire_count int, jitter_ms long"
#: (case, cursor in minutes from now, changes, fires in minutes from now, next, completed); every two minutes.
PLANS = [
    ("due within the lookahead", 1, {}, [1, 3, 5], 7, False),
    ("due just beyond it", 6, {}, [], 6, False),
    ("the last runs", 1, {"max_runs": 4, "fire_count": 2}, [1, 3], None, True),
    ("no runs left", 1, {"max_runs": 4, "fire_count": 4}, [], None, True),
    ("an end that is a fire", 1, {"end_at": 3}, [1, 3], None, True),
    ("an end before the cursor", 1, {"end_at": 0}, [], None, True),
    ("late, but not by the threshold", -1, {"misfire": "skip"}, [-1, 1, 3, 5], 7, False),
    ("late: only the last missed one", -21, {"misfire": "fire_once"}, [-1, 1, 3, 5], 7, False),
    ("late: none of the missed ones", -21, {"misfire": "skip"}, [1, 3, 5], 7, False),
    ("late: some of the missed ones", -21, {"misfire": "fire_all"}, [-5, -3, -1, 1, 3, 5], 7, False),
    ("late: missed ones use up the runs", -21, {"misfire": "fire_all", "max_runs": 2}, [-5, -3], None, True),
    ("late: over before now", -21, {"misfire": "fire_all", "end_at": -4}, [-5], None, True),
    ("paused on nothing", None, {}, [], None, False),
]


def planned(spark, rows, now=T0, limits=LIMITS):
    base = {"tenant_id": 1, "job_type": 1, "misfire": "fire_once", "every": None, "expr": None, "zone": None, "end_at": None, "max_runs": None, "fire_count": 0, "jitter_ms": None}
    return scheduling.plan(spark.createDataFrame([base | r for r in rows], SCHEDULE), now, limits)


def test_plan(spark):
    """A rate and the cron expression with the same fires are planned alike."""
    at = lambda m: None if m is None else T0 + m * MIN
    rows = []
    for i, (_, cursor, changes, *_) in enumerate(PLANS):
        own = changes | ({"end_at": at(changes["end_at"])} if "end_at" in changes else {}) | {"next_fire_at": at(cursor)}
        rows += [own | {"id": 2 * i, "kind": "fixed_rate", "every": 2 * MIN}, own | {"id": 2 * i + 1, "kind": "cron", "expr": "*/2 * * * *", "zone": "Asia/Kathmandu"}]
    p = planned(spark, rows)
    got = {r["id"]: r for r in p.collect()}
    for i, (case, _, _, fires, following, completed) in enumerate(PLANS):
        # Nepal is 5:45 ahead: even minutes there are odd ones here.
        for r in (got[2 * i], got[2 * i + 1]):
            assert (r["fires"], r["n_fires"], r["next"], r["completed"], r["error"]) == ([at(f) for f in fires], len(fires), at(following), completed, None), (case, r["kind"])
    exploded = {(r["schedule_id"], r["fire_time"]): r["run_at"] for r in scheduling.fires(p).collect()}
    assert exploded == {(r["id"], f): f for r in got.values() for f in r["fires"]}


def test_plan_of_delays_and_of_what_cannot_be_planned(spark):
    rows = [
        {"id": 0, "kind": "fixed_delay", "every": MIN, "next_fire_at": T0 - 50 * MIN},
        {"id": 1, "kind": "fixed_delay", "every": MIN, "next_fire_at": T0 + 2 * MIN, "max_runs": 1},
        {"id": 2, "kind": "cron", "expr": "99 * * * *", "next_fire_at": T0},
        {"id": 3, "kind": "cron", "expr": "@hourly", "zone": "Local", "next_fire_at": T0},
        {"id": 4, "kind": "lunar", "every": MIN, "next_fire_at": T0},
        {"id": 5, "kind": "fixed_rate", "every": 0, "next_fire_at": T0},
        {"id": 6, "kind": None, "next_fire_at": T0},
        {"id": 7, "kind": "cron", "next_fire_at": T0},
        {"id": 8, "kind": "cron", "expr": "0 0 1 1 *", "next_fire_at": T0 - 300 * DAY, "misfire": "skip"},
    ]
    got = {r["id"]: (r["fires"], r["next"], r["completed"], r["error"] is None) for r in planned(spark, rows).collect()}
    assert got[0] == ([T0 - 50 * MIN], None, False, True) and got[1] == ([T0 + 2 * MIN], None, True, True)
    assert all(got[i] == ([], T0, False, False) for i in range(2, 8))
    assert got[8][0] == [] and got[8][1] == micros("2025-01-01") and got[8][3]
    jobs = spark.createDataFrame([(1, 1, True)], "tenant_id int, name int, enabled boolean")
    ledger = spark.createDataFrame([(0, T0 - 50 * MIN)], "schedule_id long, fire_time long")
    due = planned(spark, rows).select(*(c.split()[0] for c in SCHEDULE.split(", "))).withColumn("state", F.lit("ACTIVE"))
    new, updates = scheduling.materialize_due(due, jobs, ledger, T0, LIMITS)
    assert [(r["schedule_id"], r["fire_time"]) for r in new.collect()] == [(1, T0 + 2 * MIN)]
    assert {r["id"]: r["fire_count"] for r in updates.collect()} == {0: 1, 1: 1, 8: 0}


def test_plan_is_capped_and_jittered(spark):
    rows = [{"id": 1, "kind": "fixed_rate", "misfire": "skip", "every": S, "next_fire_at": T0, "jitter_ms": 700}, {"id": 2, "kind": "cron", "expr": "* * * * * *", "next_fire_at": T0}]
    p = planned(spark, rows, T0, scheduling.Limits(lookahead=60 * MIN, max_fires=10))
    assert [(r["n_fires"], r["next"]) for r in p.orderBy("id").collect()] == [(10, T0 + 10 * S)] * 2
    late = {(r["schedule_id"], r["fire_time"]): r["run_at"] - r["fire_time"] for r in scheduling.fires(p).collect()}
    assert all(0 <= d < 700_000 and d % 1_000 == 0 for (i, _), d in late.items() if i == 1) and len({d for (i, _), d in late.items() if i == 1}) > 5
    assert {d for (i, _), d in late.items() if i == 2} == {0}


def test_upcoming_and_first_fire(spark):
    rows = [{"id": 1, "kind": "cron", "expr": "0 4 * * MON", "zone": "Europe/Paris", "next_fire_at": micros("2024-03-25T03:00")}, {"id": 2, "kind": "cron", "expr": "bad", "next_fire_at": T0}, {"id": 3, "kind": "fixed_rate", "every": MIN, "next_fire_at": T0, "max_runs": 9, "fire_count": 7}, {"id": 4, "kind": "cron", "expr": "@daily", "next_fire_at": micros("2024-03-10"), "end_at": micros("2024-03-11")}]
    s = planned(spark, rows).select(*(c.split()[0] for c in SCHEDULE.split(", ")))
    s = spark.createDataFrame([{"tenant_id": 1, "job_type": 1, "misfire": "skip", "every": None, "expr": None, "zone": None, "end_at": None, "max_runs": None, "fire_count": 0, "jitter_ms": None} | r for r in rows], SCHEDULE)
    got = {}
    for r in scheduling.upcoming(s, 3).collect():
        got.setdefault(r["schedule_id"], []).append(r["fire_time"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [micros("2024-03-25T03:00"), micros("2024-04-01T02:00"), micros("2024-04-08T02:00")], 3: [T0, T0 + MIN], 4: [micros("2024-03-10"), micros("2024-03-11")]}
    new = s.withColumn("start_at", F.when(F.col("id") == 4, micros("2024-05-05"))).withColumn("created_at", F.lit(T0 - 30 * S))
    assert {r["id"]: r["next_fire_at"] for r in changes.first_fire(new, T0).collect()} == {1: micros("2024-03-11T03:00"), 2: None, 3: T0 + 30 * S, 4: micros("2024-05-05")}


def test_next_fixed_rate(spark):
    rows = spark.createDataFrame([(T0 + m * MIN,) for m in (-7, -1, 0, 6, 7, 20)], "t long")
    got = [(r[0] - T0) // MIN for r in rows.select(scheduling.next_fixed_rate(F.lit(T0), F.lit(7 * MIN), F.col("t"))).collect()]
    assert got == [0, 0, 7, 7, 14, 21]


def sequential(policy, active, waiting, n):
    """The overlap policies one run after the other."""
    out = []
    for i in range(n):
        if policy == "allow":
            out.append("PROMOTE")
        elif policy == "skip":
            out.append("SKIP" if active else "PROMOTE")
            active = True
        elif policy == "buffer_one":
            if waiting or (active and "BUFFER" in out):
                out.append("SKIP")
            else:
                out.append("BUFFER" if active else "PROMOTE")
                active = True
        else:
            out.append("PROMOTE" if i == n - 1 else "SUPERSEDED")
    return out


def test_overlap_equals_the_sequence(spark):
    runs, expected, policies, k = [], {}, [], 0
    for policy in ("allow", "skip", "buffer_one", "cancel_previous"):
        for active in (False, True):
            for waiting in (False, True):
                for n in range(1, 6):
                    k += 1
                    policies.append((k, policy))
                    before = [("RUNNING", 1)] * active + [("SCHEDULED", 2)] * waiting
                    for state, f in before:
                        runs.append((len(runs), k, f, state, T0 + 60 * MIN))
                    ids = []
                    for i in range(n):
                        ids.append(len(runs))
                        runs.append((len(runs), k, 10 + i, "SCHEDULED", T0))
                    for i, d in zip(ids, sequential(policy, active, waiting, n), strict=True):
                        expected[i] = d
    jobs = spark.createDataFrame(runs, "id long, schedule_id long, fire_time long, state string, run_at long")
    got = scheduling.overlap_decisions(jobs, spark.createDataFrame(policies, "id long, overlap string"), T0)
    assert {r["id"]: r["decision"] for r in got.collect()} == expected


def test_jitter_is_fnv(spark):
    def fnv(data: bytes) -> int:
        h = 14695981039346656037
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    rows = [("a", T0, 1000), ("schedule-ü", T0 + 1, 7), ("", 0, 30_000), ("x", T0, 0), (None, T0, 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, at long, w long").select(hashing.jitter_ms("k", "at", "w")).collect()]
    assert got[:3] == [fnv(k.encode() + (at * 1000).to_bytes(8, "big")) % w for k, at, w in rows[:3]]
    assert got[3:] == [0, None]


# -- retries -------------------------------------------------------------------------


def decide(spark, **given):
    base = {"end": "FAILED", "retryable": True, "attempts": 1, "lost": 0, "amo": False, "cancel": False, "started": T0, "deadline": None, "after": None} | given
    df = spark.createDataFrame([base], "end string, retryable boolean, attempts int, lost int, amo boolean, cancel boolean, started long, deadline long, after long")
    c = F.col
    d = df.select(dispatch.retry_decision(c("end"), c("retryable"), c("attempts"), c("lost"), c("amo"), c("cancel"), c("started"), c("deadline"), F.lit(T0), retry_after_ms=c("after")).alias("d")).first()["d"]
    return d["next"], d["reason"], None if d["run_at"] is None else (d["run_at"] - T0) // S


RETRIES = [
    ({"end": "SUCCEEDED", "cancel": True}, ("SUCCEEDED", None, None)),
    ({"cancel": True}, ("CANCELLED", "CANCELLED", None)),
    ({"end": "CANCELLED"}, ("CANCELLED", "CANCELLED", None)),
    ({"retryable": False}, ("FAILED", "NON_RETRYABLE", None)),
    ({"amo": True}, ("FAILED", "AT_MOST_ONCE", None)),
    ({"amo": True, "end": "LOST"}, ("FAILED", "OUTCOME_UNKNOWN", None)),
    ({"amo": True, "end": "TIMED_OUT"}, ("FAILED", "OUTCOME_UNKNOWN", None)),
    ({"end": "LOST", "attempts": 3, "lost": 3}, ("DEAD_LETTERED", "POISON", None)),
    ({"end": "LOST", "attempts": 2, "lost": 2}, ("RETRY_PENDING", "LOST", 20)),
    ({"attempts": 10}, ("DEAD_LETTERED", "ATTEMPTS_EXHAUSTED", None)),
    ({"attempts": 9}, ("RETRY_PENDING", "RETRYABLE_ERROR", 2560)),
    ({"end": "TIMED_OUT"}, ("RETRY_PENDING", "TIMED_OUT", 10)),
    ({"after": 90_000}, ("RETRY_PENDING", "RETRYABLE_ERROR", 90)),
    ({"after": 10_800_000}, ("RETRY_PENDING", "RETRYABLE_ERROR", 3600)),
    ({"started": T0 - 86_400 * S + 5 * S}, ("DEAD_LETTERED", "DEADLINE_EXCEEDED", None)),
    ({"deadline": T0 + 5 * S}, ("DEAD_LETTERED", "DEADLINE_EXCEEDED", None)),
    ({"deadline": T0 + 10 * S}, ("RETRY_PENDING", "RETRYABLE_ERROR", 10)),
]


@pytest.mark.parametrize("given,expected", RETRIES)
def test_retry_decision(spark, given, expected):
    assert decide(spark, **given) == expected


def test_backoff(spark):
    rows = spark.createDataFrame([(n,) for n in (*range(1, 12), 1000)], "n int")
    got = [r[0] // S for r in rows.select(dispatch.backoff_us(F.col("n"))).collect()]
    assert got == [10, 20, 40, 80, 160, 320, 640, 1280, 2560, 3600, 3600, 3600]
    assert {r[0] for r in rows.select(dispatch.backoff_us(F.col("n"), dispatch.RETRY | {"strategy": "fixed"})).collect()} == {10 * S}
    odd = dispatch.delays_us(dispatch.RETRY | {"initial_delay_ms": 1_000, "multiplier": 1.1})
    assert odd[:4] == [1_000_000, 1_100_000, 1_210_000, 1_331_000] and odd[-1] == 3600 * S and dispatch.delays_us(dispatch.RETRY | {"multiplier": 1.0}) == [10 * S]


def test_policy_violations(spark):
    fields = "strategy string, multiplier double, jitter string, initial_delay_ms long, max_delay_ms long, max_attempts int, max_retry_duration_ms long, max_lost_attempts int"
    rows = [("exponential", 2.0, "full", 10_000, 3_600_000, 10, 86_400_000, 3), ("linear", 0.0, "some", 1, 0, 51, 0, 60), ("exponential", 11.0, "none", 1_000, 86_400_001, 0, 604_800_001, 0), ("fixed", 0.0, "none", 1_000, 1_000, 1, 1, 1)]
    df = spark.createDataFrame(rows, fields).select(dispatch.policy_violations(F.struct("*")).alias("v"))
    got = [r["v"] for r in df.collect()]
    assert got == [[], ["strategy", "jitter", "initial_delay_ms", "max_delay_ms", "max_attempts", "max_retry_duration_ms", "max_lost_attempts"], ["multiplier", "max_delay_ms", "max_attempts", "max_retry_duration_ms", "max_lost_attempts"], []]


def test_small_operators(spark):
    rows = lists.zipped(spark, "id long, pool string, run_at long", [1, 2, 3], ["a", "b", "a"], [T0 - 1, T0, T0 + 1])
    assert [r["id"] for r in lists.lookup(rows, pool="a", id=3).collect()] == [3]
    assert lists.in_scope(rows, "b").count() == 1 and lists.in_scope(rows, "").count() == 3
    assert [(r["state"], r["ready_at"]) for r in admission.new_jobs(rows, T0).orderBy("id").collect()] == [("READY", T0), ("READY", T0), ("SCHEDULED", None)]
    assert rows.limit(1).select(metrics.clock_offset(F.lit(1_000), F.lit(100), F.lit(300))).first()[0] == 750


def test_fires_equal_the_table_function(spark):
    """The calendar expansion against stepping from fire to fire, by a table function."""
    spark.udtf.register("next_fires", cron.NextFires)
    a = micros("2022-10-24T06:00")
    for expr in ("*/20 1-3 * * *", "45 2 * * 0", "0 0 1-6 * 3"):
        for zone in ("America/St_Johns", "Australia/Lord_Howe"):
            until = a + 16 * DAY
            steps = [r["fire_time"] for r in spark.sql(f"SELECT * FROM next_fires('{expr}', '{zone}', {a}L, 400)").collect()]
            assert expanded(spark, [(expr, zone, a, until)]) == [[f for f in steps if f <= until]]


def test_state_machine(spark):
    moves = spark.createDataFrame([("READY", "RUNNING", "dispatcher"), ("READY", "RUNNING", "api"), ("SUCCEEDED", "READY", "api"), ("FAILED", "READY", "api")], "from_state string, to_state string, actor string")
    assert {(r["from_state"], r["actor"]): r["allowed"] for r in states.check(moves).collect()} == {("READY", "dispatcher"): True, ("READY", "api"): False, ("SUCCEEDED", "api"): False, ("FAILED", "api"): True}
    assert len({(a, b) for a, b, _ in states.JOB_EDGES}) == 23 and len(states.JOB_EDGES) == 32
    attempts = spark.createDataFrame([("RUNNING", "LOST", "reaper"), ("RUNNING", "SUCCEEDED", "reaper"), ("LOST", "FAILED", "dispatcher")], "from_state string, to_state string, actor string")
    assert [r["allowed"] for r in states.check_attempts(attempts).collect()] == [True, False, False]


def test_weighted_round_robin(spark):
    credits = dict.fromkeys(dispatch.WEIGHTS, 0)
    cycle = "".join("?LNHC"[dispatch.pick(credits, [4, 3, 2, 1])] for _ in range(15))
    assert cycle == "CHCNCHCLCHCNCHC" and set(credits.values()) == {0}
    assert dispatch.allocate({4: 99, 3: 99, 2: 99, 1: 99}, 15) == {4: 8, 3: 4, 2: 2, 1: 1}
    assert dispatch.allocate({3: 99, 1: 99}, 6) == {3: 5, 1: 1}
    assert dispatch.allocate({4: 1, 1: 2}, 9) == {4: 1, 1: 2}
    rows = spark.createDataFrame([("p", p, n, 10 * p + n) for p in (1, 2, 3, 4) for n in range(8)], "pool string, priority int, run_at int, id int")
    got = dispatch.interleave(rows, ["pool"], [F.col("run_at"), F.col("id")]).orderBy("turn").limit(15).collect()
    assert "".join("?LNHC"[r["priority"]] for r in got) == cycle


# -- claims, sessions -------------------------------------------------------------------


def test_claim_allowances(spark):
    job = "id long, tenant_id int, job_type int, pool string, state string, priority int, run_at long, start_deadline long, attempt_count int"
    rows = [(i, 1, 1, "p", "READY", 2, T0 - 100 + i, None, 0) for i in range(5)] + [(10 + i, 2, 1, "p", "READY", 2, T0 - 50 + i, None, 0) for i in range(3)]
    rows += [(20, 2, 1, "p", "READY", 2, T0 - 200, T0 - 1, 0), (21, 2, 2, "p", "READY", 2, T0 - 200, None, 0), (22, 2, 1, "q", "READY", 2, T0 - 200, None, 0)]
    types = spark.createDataFrame([(1, 1, False, 60_000), (2, 1, False, 60_000), (2, 2, True, 60_000)], "tenant_id int, name int, paused boolean, attempt_timeout_ms long")
    tenants = spark.createDataFrame([(1, 2), (2, None)], "id int, max_running int")
    pools = spark.createDataFrame([("p", False), ("q", True)], "name string, paused boolean")
    got = dispatch.claim(spark.createDataFrame(rows, job), tenants, types, pools, T0, 10).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 10, 11, 12]
    assert {r["deadline"] for r in got} == {T0 + 60 * S} and {r["attempt"] for r in got} == {1}


def test_claim_skips_tenants_at_their_cap(spark):
    """A thousand jobs of a tenant at its cap wait ahead of five of a free one; and of one that may start one more."""
    job = "id long, tenant_id int, job_type int, pool string, state string, priority int, run_at long, start_deadline long, attempt_count int"
    rows = [(i, 1, 1, "p", "READY", 2, T0 - 5_000 + i, None, 0) for i in range(1_000)] + [(2_000 + i, 2, 1 + i % 2, "p", "READY", 2, T0 - 50 + i, None, 0) for i in range(5)]
    rows += [(3_000, 1, 1, "p", "RUNNING", 2, T0, None, 1), (3_001, 3, 1, "p", "READY", 4, T0 - 9, None, 0), (3_002, 3, 1, "p", "READY", 2, T0 - 9_000, None, 0), (3_003, 3, 1, "p", "READY", 1, T0 - 9, None, 0)]
    types = spark.createDataFrame([(t, n, False, 60_000) for t in (1, 2, 3) for n in (1, 2)], "tenant_id int, name int, paused boolean, attempt_timeout_ms long")
    tenants = spark.createDataFrame([(1, 1), (2, None), (3, 1)], "id int, max_running int")
    pools = spark.createDataFrame([("p", False)], "name string, paused boolean")
    jobs = spark.createDataFrame(rows, job)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    free = [2_000, 2_001, 2_002, 2_003, 2_004]
    assert ids(dispatch.claim(jobs, tenants, types, pools, T0, 10)) == [*free, 3_001, 3_002, 3_003]
    assert ids(dispatch.claim(jobs, tenants, types, pools, T0, 10, [2])) == [2_001, 2_003]
    assert ids(rounds.claim_round(jobs, tenants, types, pools, T0, 10)) == [*free, 3_001]
    leases = spark.createDataFrame([("pool:p", "a", 7)], "name string, holder string, epoch long")
    claims = lambda epoch: spark.createDataFrame([("pool:p", "a", epoch)], leases.schema)
    assert dispatch.fenced(jobs, claims(7), leases).count() == len(rows) and dispatch.fenced(jobs, claims(6), leases).count() == 0


def test_sessions_open_drain_and_close(spark):
    sessions = spark.createDataFrame([(1, "p", "w1", 4, "ACTIVE", T0 + S, False), (2, "p", "w2", 4, "EXPIRED", T0 - S, False)], "id long, pool string, worker_id string, slots int, state string, lease_expires_at long, draining boolean")
    asked = spark.createDataFrame([(1, "q", "other", 9), (3, "q", "w3", 2), (3, "q", "w3", 2)], "id long, pool string, worker_id string, slots int")
    assert [(r["id"], r["worker_id"], r["state"], r["lease_expires_at"]) for r in dispatch.open_session(sessions, asked, T0).orderBy("id").collect()] == [(1, "w1", "ACTIVE", T0 + S), (2, "w2", "EXPIRED", T0 - S), (3, "w3", "ACTIVE", T0 + 30 * S)]
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    assert [tuple(r) for r in dispatch.drain_sessions(sessions, ids).collect()] == [(1, True)]
    held = "id long, state string, session_id long, attempt_count int, budget_lost int, at_most_once boolean, cancel_requested_at long, attempt_started_at long, deadline long"
    jobs = spark.createDataFrame([(10, "RUNNING", 1, 1, 0, False, None, T0, None), (11, "RUNNING", 2, 1, 0, False, None, T0, None), (12, "RUNNING", 1, 1, 0, True, None, T0, None)], held)
    ends, lost = dispatch.close_sessions(sessions, ids, jobs, T0)
    assert [tuple(r) for r in ends.collect()] == [(1, "CLOSED", T0)]
    assert {r["id"]: (r["next"], r["reason"]) for r in lost.collect()} == {10: ("RETRY_PENDING", "LOST"), 12: ("FAILED", "OUTCOME_UNKNOWN")}


def test_attempt_facts(spark):
    jobs = spark.createDataFrame([(1, "RUNNING", 5, 7, 2, T0, T0 + MIN), (2, "READY", 5, None, 1, None, None)], "id long, state string, tenant_id int, session_id long, attempt_count int, attempt_started_at long, attempt_deadline long")
    reports = spark.createDataFrame([(1, 2, "FAILED", True), (1, 1, "SUCCEEDED", None), (2, 1, "LOST", None)], "job_id long, attempt int, outcome string, retryable boolean")
    assert [tuple(r) for r in dispatch.ended_attempts(jobs, reports, T0 + S).collect()] == [(1, 5, 2, 7, "FAILED", True, T0, T0 + MIN, T0 + S)]


def test_cursor_round_trip(spark):
    got = spark.createDataFrame([(T0, 7)], "c long, i long").select(lists.cursor(F.col("c"), F.col("i"))).first()[0]
    assert lists.read_cursor(got) == (T0, 7) and not set(got) & set("+/=")


def test_lease_log():
    state = None
    said = []
    for holder, action, at, epoch in [("a", "acquire", 0, None), ("b", "acquire", 5, None), ("a", "renew", 12, 1), ("b", "acquire", 20, None), ("b", "acquire", 22, None), ("a", "renew", 23, 1), ("b", "release", 24, 2), ("a", "acquire", 24, None)]:
        granted, state = streams.decide_lease(state, holder, action, at, 10, epoch)
        said.append((granted, state[1]))
    assert said == [(True, 1), (False, 1), (True, 1), (False, 1), (True, 2), (False, 2), (True, 2), (True, 3)]


def test_warm_up():
    w = streams.WarmUp(30 * S)
    assert [w.step(t * S, ok) for t, ok in ((0, True), (20, True), (30, True), (31, False), (40, True), (69, True), (70, True))] == [False, False, True, False, False, False, True]


# -- admission ----------------------------------------------------------------------------


def test_token_bucket(spark):
    rows = spark.createDataFrame([(1, T0, i, 1.0) for i in range(3)] + [(1, T0 + 1_500_000, 3, 1.0), (1, T0 + 60 * S, 4, 1.0)], "tenant_id int, ts long, id long, rate double")
    got = {r["id"]: (r["allowed"], round(r["wait"], 6)) for r in admission.token_bucket(rows, "tenant_id", "rate").collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 1.0), 3: (True, 0.0), 4: (True, 0.0)}


def test_token_bucket_without_a_rate(spark):
    rows = spark.createDataFrame([(1, T0, 0, 0.0), (1, T0 + S, 1, 0.0), (2, T0, 2, None), (3, T0, 3, -1.0)], "tenant_id int, ts long, id long, rate double")
    got = {r["id"]: (r["allowed"], r["wait"]) for r in admission.token_bucket(rows, "tenant_id", "rate").collect()}
    assert got == {0: (False, math.inf), 1: (False, math.inf), 2: (True, 0.0), 3: (False, math.inf)}
    fresh = spark.createDataFrame([(T0 - 59 * S,), (T0 - 60 * S,), (None,)], "t long").select(admission.is_fresh(F.col("t"), T0)).collect()
    assert [r[0] for r in fresh] == [True, False, False]


def test_labels_and_small_facts(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"a": "x"}), (3, {}), (4, None)], "id long, labels map<string,string>")
    ids = lambda **labels: [r["id"] for r in df.where(lists.list_filter(labels=labels)).orderBy("id").collect()]
    assert ids(a="x") == [1, 2] and ids(a="x", b="y") == [1] and ids(b="z") == [] and ids() == [1, 2, 3, 4]
    due = spark.createDataFrame([(1, T0 - 3 * S)], "id long, run_at long")
    assert [(r["state"], r["ready_at"], r["lag"]) for r in scheduling.promoted(due, T0).collect()] == [("READY", T0, 3 * S)]
    wait = due.select(metrics.dispatch_latency(F.lit(T0), F.lit(T0 + 9), F.lit(T0 + 4), F.lit(None).cast("long")), metrics.dispatch_latency(F.lit(T0), F.lit(T0 + 9), F.lit(T0 + 4), F.lit(T0 + 11))).first()
    assert (wait[0], wait[1]) == (5, 0)


def test_shed(spark):
    rows = [(1, 600_000, 300_000, True), (2, 600_000, 300_000, True), (2, 1_200_000, 300_000, True), (3, 9_000_000, 300_000, True), (1, 600_000, 300_000, False), (1, None, 300_000, True)]
    df = spark.createDataFrame(rows, "p int, age long, target long, fresh boolean")
    assert [r[0] for r in df.select(admission.shed(F.col("p"), F.col("age"), F.col("target"), F.col("fresh"))).collect()] == [True, False, True, False, False, False]
    assert df.limit(1).select(admission.shed(F.lit(1), F.lit(None), F.lit(1), F.lit(False), F.lit(True))).first()[0] is True


def test_fields(spark):
    df = spark.createDataFrame([("ok-1", {"a": "b"}, None, None), ("Bad", {"": "x" * 300}, "d" * 256, "c" * 129)], "n string, l map<string,string>, d string, c string")
    got = [r[0] for r in df.select(admission.violations(F.col("n"), F.col("l"), F.col("d"), F.col("c"))).collect()]
    assert got == [[], ["name", "label key", "label value", "dedupe_key", "correlation_id"]]
    ids = spark.createDataFrame([("0190A3F2-7B3C-7000-8000-0123456789AB",), ("nope",)], "u string").select(admission.canonical_uuid(F.col("u"))).collect()
    assert [r[0] for r in ids] == ["0190a3f2-7b3c-7000-8000-0123456789ab", None]


# -- text -----------------------------------------------------------------------------------


def test_durations(spark):
    cases = {"10m": 600 * S, "1h30m": 5400 * S, "1.5s": 1_500_000, "-2ms": -2000, "0": 0, "3us": 3, "1500ns": 1, "": None, "5": None, "1x": None, "h": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.duration_micros(F.col("t")).alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == cases


def test_truncate_and_sets(spark):
    df = spark.createDataFrame([("aüb", 2), ("aüb", 3), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(text.truncate_utf8("t", "n")).collect()] == ["a", "aü", None]
    whole = "aüß€𝄞z"
    cuts = spark.createDataFrame([(whole, n) for n in range(16)], "t string, n int").select("n", text.truncate_utf8("t", "n").alias("c")).collect()
    assert {r["n"]: r["c"] for r in cuts} == {n: whole.encode()[:n].decode("utf-8", "ignore") for n in range(16)}
    assert spark.range(1).select(text.set_key(F.array(F.lit("b"), F.lit("a"), F.lit("b")), ",")).first()[0] == "a,b"


def test_strict_json(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"c": 1}',), ("{",), ("",)], "t string").select(text.strict_json(F.col("t"), schema).alias("r"))
    got = [(r["r"]["value"], r["r"]["error"]) for r in df.collect()]
    assert got[0][0]["a"] == 1 and got[0][1] is None
    assert [g[1] for g in got[1:3]] == ["unknown field c", "malformed JSON"] and got[3][1] is None


def test_strict_json_inside(spark):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("a long, o struct<x: long, l: array<struct<k: string>>>")
    rows = ['{"a": 1, "o": {"x": 2, "l": [{"k": "v"}, {}]}}', '{"o": {"y": 2}}', '{"o": {"l": [{"k": "v"}, {"q": 1}]}}', '{"a": "x"}', '{"o": {"x": "2 apples"}}', '{"o": null}', '{"o": {"l": [3]}}']
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(text.strict_json(F.col("t"), schema).alias("r"))
    got = [r["r"]["error"] for r in df.collect()]
    assert got == [None, "unknown field o.y", "unknown field o.l.[].q", "a value of another type", "a value of another type", None, "a value of another type"]


SCHEMA = {"type": "object", "required": ["to"], "properties": {"to": {"type": "string", "pattern": "@"}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}


def test_json_schema(spark):
    import json

    assert text.schema_errors({"to": "a@b", "n": 2}, SCHEMA) == []
    assert len(text.schema_errors({"to": "x", "n": 0, "z": 1}, SCHEMA)) == 3
    assert text.schema_errors({"n": True}, SCHEMA) == ["/: lacks to", "/n: is not integer"]
    with pytest.raises(ValueError):
        text.schema_errors(1, {"$ref": "http://x"})
    df = spark.createDataFrame([('{"to": "a@b"}', json.dumps(SCHEMA)), ("[]", json.dumps(SCHEMA)), ("{", "{}"), ("1", None)], "p string, s string")
    got = [r[0] for r in df.select(text.validate_payload("p", "s")).collect()]
    assert got[0] is None and "is not object" in got[1] and got[2] and got[3] is None


def test_json_schema_conditions_and_references():
    ok = lambda v, s: text.schema_errors(v, s) == []
    when = {"if": {"properties": {"kind": {"const": "mail"}}, "required": ["kind"]}, "then": {"required": ["to"]}, "else": {"required": ["url"]}}
    assert ok({"kind": "mail", "to": 1}, when) and ok({"url": 1}, when) and not ok({"kind": "mail"}, when) and not ok({"kind": "hook"}, when)
    has = {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}
    assert [ok(v, has) for v in ([1, "a", 2], [1], [1, 2, 3, 4], ["a"])] == [True, False, False, False] and ok(["x"], {"contains": {"type": "integer"}, "minContains": 0})
    assert not ok({"card": 1}, {"dependentRequired": {"card": ["address"]}}) and ok({"name": 1}, {"dependentRequired": {"card": ["address"]}})
    assert not ok({"card": 1}, {"dependentSchemas": {"card": {"minProperties": 2}}}) and not ok({"Bad": 1}, {"propertyNames": {"pattern": "^[a-z]+$"}})
    tree = {"$defs": {"node": {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}, "v": {"type": "integer"}}, "required": ["v"]}}, "$ref": "#/$defs/node"}
    assert ok({"v": 1, "next": {"v": 2, "next": {"v": 3}}}, tree) and not ok({"v": 1, "next": {"v": 2, "next": {}}}, tree)
    assert ok([[], [[]]], {"type": "array", "items": {"$ref": "#"}}) and not ok([[], [1]], {"type": "array", "items": {"$ref": "#"}})
    for bad in ({"properties": {"never": {"$ref": "http://x/y"}}}, {"anyOf": [{"$ref": "other.json"}]}, {"$ref": "#/$defs/none"}, {"$dynamicRef": "#x"}, {"$ref": "#"}):
        with pytest.raises(ValueError):
            text.schema_errors({}, bad)


@pytest.mark.parametrize(
    ("schema", "fits", "breaks"),
    [
        ({"properties": {"a": {}}, "unevaluatedProperties": False}, [{"a": 1}, {}, 7, []], [{"b": 1}]),
        ({"allOf": [{"properties": {"a": {}}}], "patternProperties": {"^x": {}}, "unevaluatedProperties": {"type": "string"}}, [{"a": 1, "xy": 2, "b": "s"}], [{"b": 2}]),
        ({"anyOf": [{"properties": {"a": {"type": "string"}}, "required": ["a"]}, {"properties": {"b": {}}}], "unevaluatedProperties": False}, [{"a": "s"}, {"a": "s", "b": 0}, {"b": 1}], [{"a": 3}, {"c": 1}]),
        ({"if": {"properties": {"k": {"const": 1}}}, "then": {"properties": {"t": {}}}, "else": {"properties": {"e": {}, "k": {}}}, "unevaluatedProperties": False}, [{"k": 1, "t": 0}, {"k": 2, "e": 0}], [{"k": 1, "e": 0}, {"k": 2, "t": 0}]),
        ({"$ref": "#/$defs/d", "$defs": {"d": {"properties": {"a": {}}, "dependentSchemas": {"a": {"properties": {"b": {}}}}}}, "unevaluatedProperties": False}, [{"a": 1, "b": 2}], [{"b": 2}]),
        ({"not": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "unevaluatedProperties": False}, [{}], [{"a": 2}]),
        ({"allOf": [{"additionalProperties": True}], "unevaluatedProperties": False}, [{"z": 1}], []),
        ({"properties": {"in": {"unevaluatedProperties": False}}, "unevaluatedProperties": False}, [{"in": {}}], [{"in": {"a": 1}}, {"out": 1}]),
        ({"prefixItems": [{}], "contains": {"type": "string"}, "unevaluatedItems": False}, [[1, "a"], ["a"]], [[1, "a", 2], [1, 2]]),
        ({"allOf": [{"items": {"type": "integer"}}], "unevaluatedItems": False}, [[1, 2], []], [["a"]]),
        ({"oneOf": [{"prefixItems": [{"const": 1}]}, {"prefixItems": [{"const": 2}, {}]}], "unevaluatedItems": {"type": "null"}}, [[1, None], [2, 3, None]], [[1, 3], [2, 3, 4]]),
    ],
)
def test_unevaluated_parts(schema, fits, breaks):
    assert [text.schema_errors(v, schema) for v in fits] == [[]] * len(fits)
    assert all(text.schema_errors(v, schema) for v in breaks)


def test_leases_end_here_before_they_end_there(spark):
    log = [
        (1, "a", "x", 0, 1, "acquired"), (2, "a", "x", 3 * S, 4 * S, "renewed"), (3, "a", "x", 6 * S, 7 * S, "failed"),  # until 11 s
        (4, "b", "x", 0, 1, "acquired"), (5, "b", "x", 3 * S, 9 * S, "renewed"),  # answered after 8 s: given back
        (6, "c", "x", 0, 1, "acquired"), (7, "c", "x", 3 * S, 4 * S, "lost"), (8, "c", "y", 5 * S, 6 * S, "acquired"),
        (9, "d", "x", 0, 1, "acquired"), (10, "d", "x", 2 * S, 2 * S, "released"), (11, "d", "x", 4 * S, 5 * S, "acquired"),
        (12, "e", "x", 0, 1, "failed"),
    ]
    rows = spark.createDataFrame(log, "id long, name string, holder string, started long, finished long, outcome string")
    got = {(r["name"], r["holder"]): (r["held_until"], r["held"]) for r in changes.held_until(rows, 11 * S).collect()}
    assert got == {("a", "x"): (11 * S, False), ("b", "x"): (None, False), ("c", "x"): (None, False), ("c", "y"): (13 * S, True), ("d", "x"): (12 * S, True)}


def test_error_status(spark):
    got = spark.createDataFrame([("conflict",), ("?",)], "e string").select(text.error_status(F.col("e")).alias("s")).collect()
    assert [(r["s"]["status"], r["s"]["code"]) for r in got] == [(409, "conflict"), (500, "internal")]


def test_humanize(spark):
    r = spark.range(1).select(text.humanize_duration(F.lit(90061.0)), text.humanize_duration(F.lit(2.5)), text.humanize_percentage(F.lit(0.05))).first()
    assert (r[0], r[1], r[2]) == ("1d 1h 1m 1s", "2.5s", "5%")


# -- metrics ----------------------------------------------------------------------------------


def test_quantiles_and_shares(spark):
    inf = math.inf
    b = spark.createDataFrame([("x", 0.1, 50), ("x", 0.5, 90), ("x", 1.0, 99), ("x", inf, 100), ("e", 0.1, 0), ("e", inf, 0)], "s string, le double, n long")
    for q, want in ((0.5, 0.1), (0.7, 0.3), (0.99, 1.0), (0.999, 1.0)):
        got = {r["s"]: r["q"] for r in metrics.quantile(b, ["s"], q).collect()}
        assert got["x"] == pytest.approx(want) and math.isnan(got["e"])
    c = spark.createDataFrame([("x", 0.5, 900), ("x", 1.0, 990), ("x", 2.5, 999), ("x", inf, 1000)], "s string, le double, n long")
    assert metrics.share_at(c, ["s"], 1.0).first()["share"] == pytest.approx(0.99)
    assert math.isnan(metrics.share_at(c, ["s"], 0.75).first()["share"])


def test_change_and_checks(spark):
    label = "p string, pr string, value double"
    before = spark.createDataFrame([("a", "NORMAL", 10.0), ("b", "NORMAL", 5.0)], label)
    after = spark.createDataFrame([("a", "NORMAL", 30.0), ("b", "NORMAL", 15.0), ("b", "HIGH", 4.0)], label)
    assert {r["pr"]: r["change"] for r in metrics.change(before, after, ["pr"]).collect()} == {"NORMAL": 30.0, "HIGH": 4.0}
    m = spark.createDataFrame([("a", 0.995, 0.99), ("b", math.nan, 0.99), ("c", 0.5, 0.99)], "name string, value double, floor double")
    assert [r["passed"] for r in metrics.checks(m).orderBy("name").collect()] == [True, False, False]


def test_alert_waits_for_its_duration(spark):
    rows = [("p", t * MIN, float(v)) for t, v in ((0, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 1))]
    got = metrics.held_for(spark.createDataFrame(rows, "s string, ts long, value double"), ["s"], F.col("value") > 0, 2 * MIN).orderBy("ts").collect()
    assert [r["firing"] for r in got] == [False, False, False, False, False, True]


def test_minute_boundaries(spark):
    r = spark.range(1).select(metrics.minute_boundaries(F.lit(60 * S), F.lit(180 * S)), metrics.minute_boundaries(F.lit(61 * S), F.lit(119 * S))).first()
    assert (r[0], r[1]) == (2, 0)


def test_increase_to_the_edges(spark):
    """Edges nearer than 1.1 times the samples' mean distance are reached, others by half of it, and no counter is carried below 0."""
    t = lambda *v: [(T0 + a * S, float(b)) for a, b in v]
    cases = {
        "reaches both": (t((10, 5), (20, 7), (30, 9), (40, 11), (50, 13)), 8 * 60 / 40),
        "reset": (t((10, 50), (20, 70), (30, 4), (40, 6), (50, 8)), 28 * 60 / 40),
        "far edges": (t((25, 10), (30, 11), (35, 12)), 2 * 15 / 10),
        "from zero": (t((9, 1), (19, 21), (29, 41), (39, 61), (49, 81), (59, 101)), 100 * (50 + 0.5 + 1) / 50),
        "flat": (t((10, 3), (40, 3)), 0.0),
    }
    rows = [(k, *x) for k, (v, _) in cases.items() for x in v] + [("one", T0 + 5 * S, 1.0), ("late", T0, 5.0), ("late", T0 + 61 * S, 9.0)]
    got = {r["s"]: r["increase"] for r in metrics.increase(spark.createDataFrame(rows, "s string, ts long, value double"), ["s"], T0, T0 + 60 * S).collect()}
    assert got == {k: pytest.approx(x) for k, (_, x) in cases.items()}


def test_exposition_round_trip(spark):
    rows = [("a", {"p": 'q"r\\s\nt', "z": ""}, 3.5), ("b", {}, math.inf), ("c", {"x": "\\n"}, -0.25)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, value double")
    assert sorted((r["name"], r["labels"], r["value"]) for r in exposition.parse(exposition.lines(df)).collect()) == rows


def test_exposition(spark):
    lines = ["# HELP x y", "", 'a{p="q\\"r\\\\s\\nt",z=""} 3.5 1700000000', "b 2", "c{} +Inf"]
    got = exposition.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["name"], r["labels"], r["value"]) for r in got] == [("a", {"p": 'q"r\\s\nt', "z": ""}, 3.5), ("b", {}, 2.0), ("c", {}, math.inf)]
    bad = ["a{p=q} 1", "a{p=\"q\" 1", "a", "a x", "{p=\"q\"} 1"]
    out = exposition.parse(spark.createDataFrame([(x,) for x in bad], "value string"), strict=False).collect()
    assert [r["bad"] for r in out] == bad
    with pytest.raises(Exception, match="malformed series"):
        exposition.parse(spark.createDataFrame([(bad[0],)], "value string")).collect()


# -- handlers, streams -----------------------------------------------------------------------------


def test_handlers():
    def slow(job):
        raise handlers.RetryAfter("later", 500)

    def broken(job):
        raise RuntimeError("no")

    h = {"email.send": handlers.email_send, "slow": slow, "broken": broken}
    run = lambda kind, payload="{}", **k: handlers.run_one(h, {"id": 1, "job_type": kind, "payload": payload} | k)
    assert run("email.send", '{"to": "a"}')["result"] == '{"sent": "a"}'
    assert (run("email.send")["outcome"], run("email.send")["retryable"]) == ("FAILED", False)
    assert (run("slow")["retryable"], run("slow")["retry_after_ms"]) == (True, 500)
    assert run("broken")["error"] == "RuntimeError: no" and run("none")["retryable"] is False
    slept = []
    assert handlers.demo_sleep({"payload": '{"seconds": 2.5}'}, slept.append) == {"slept": True} and slept == [2.5]
    assert run("demo", "[]")["retryable"] is False and handlers.run_one({"demo": handlers.demo_sleep}, {"id": 1, "job_type": "demo", "payload": "no"})["retryable"] is False
    clock = iter([0.0, 1.0])
    assert handlers.run_one({"x": lambda j: 1}, {"id": 1, "job_type": "x", "payload": "", "timeout_ms": 300}, lambda: next(clock))["outcome"] == "TIMED_OUT"


def test_tick_is_idempotent(spark, tmp_path):
    run = streams.tick(spark, str(tmp_path / "jobs"), [lambda df, now: df.withColumn("n", F.col("n") + 1)], lambda: 0)
    new = spark.createDataFrame([(1, 0)], "id long, n long")
    for batch in (0, 0, 1):
        run(new if batch == 0 else spark.createDataFrame([(2, 0)], "id long, n long"), batch)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "jobs" / "batch=1")).select("id", "n").collect())) == [(1, 2), (2, 1)]


def test_stream_dedup_and_leases(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("x", i, h, a, at, e) for i, (h, a, at, e) in enumerate([("a", "acquire", 0, None), ("b", "acquire", 5 * S, None), ("b", "acquire", 20 * S, None), ("a", "renew", 21 * S, 1)])], "name string, seq long, holder string, action string, at long, epoch long").coalesce(1).write.parquet(str(src))
    log = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = streams.leases(log).writeStream.format("memory").queryName("leases_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["granted"], r["epoch"]) for r in spark.table("leases_out").orderBy("seq").collect()] == [(True, 1), (False, 1), (True, 2), (False, 2)]
    spark.range(6).select((F.col("id") % 2).cast("int").alias("tenant_id"), F.lit("k").alias("idempotency_key"), F.timestamp_seconds(F.col("id")).alias("ts"), "id").coalesce(1).write.parquet(str(tmp_path / "r"))
    req = spark.readStream.schema(spark.read.parquet(str(tmp_path / "r")).schema).parquet(str(tmp_path / "r"))
    q = streams.first_submissions(req).writeStream.format("memory").queryName("first_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_out").count() == 2
