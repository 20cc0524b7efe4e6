"""Queries about schedules: planned fires, cron, promotion, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.functions import cron, hashing
from quillon.operators import scheduling
from quillon.sources.views import DAY, NOW, SECOND

from .registry import Tables, query

HORIZON = NOW + 150 * SECOND
#: The planner as a loop over each schedule's own fires: an independent form, row by row.
#: Every fire of the cron schedules of the view around NOW, each instant tested against its expression in local time; their zones keep one offset here.
CRON_FIRES = f"""cron_fires AS (SELECT expr, f FROM (SELECT expr, epoch_us(m) AS f, m + to_minutes(shift) AS w FROM (SELECT unnest(generate_series(TIMESTAMP '1999-12-29 00:00:00', TIMESTAMP '2000-02-05 00:00:00', INTERVAL 30 SECOND)) AS m),
    (VALUES ('*/15 * * * *', 0), ('0 9 * * MON-FRI', -300), ('30 * * * * *', 0), ('0 */6 * * *', 330)) v(expr, shift))
    WHERE CASE expr WHEN '*/15 * * * *' THEN minute(w) % 15 = 0 AND second(w) = 0 WHEN '0 9 * * MON-FRI' THEN second(w) = 0 AND minute(w) = 0 AND hour(w) = 9 AND dayofweek(w) BETWEEN 1 AND 5
        WHEN '30 * * * * *' THEN second(w) = 30 ELSE second(w) = 0 AND minute(w) = 0 AND hour(w) % 6 = 0 END)"""
PLAN = f"""
WITH {CRON_FIRES}, due AS (SELECT s.* FROM schedules s JOIN job_types y ON y.tenant_id = s.tenant_id AND y.name = s.job_type AND y.enabled WHERE s.state = 'ACTIVE' AND s.next_fire_at <= {HORIZON}),
r AS (SELECT *, CASE WHEN max_runs IS NOT NULL THEN max_runs - fire_count ELSE 4611686018427387904 END AS remaining FROM due),
grid AS (SELECT id, unnest(generate_series(next_fire_at, {HORIZON} + every * 2, every)) AS f FROM r WHERE kind = 'fixed_rate' UNION ALL SELECT r.id, c.f FROM r JOIN cron_fires c ON c.expr = r.expr AND c.f >= r.next_fire_at),
missed AS (SELECT g.id, g.f, row_number() OVER (PARTITION BY g.id ORDER BY g.f DESC) AS back FROM grid g WHERE g.f <= {NOW}),
late AS (SELECT id FROM r WHERE next_fire_at < {NOW - 60 * SECOND}),
chosen AS (
    SELECT g.id, g.f FROM grid g JOIN r ON r.id = g.id WHERE g.f <= {HORIZON} AND (g.id NOT IN (SELECT id FROM late) OR g.f > {NOW})
    UNION ALL SELECT m.id, m.f FROM missed m JOIN r ON r.id = m.id WHERE m.id IN (SELECT id FROM late) AND CASE r.misfire WHEN 'fire_once' THEN m.back = 1 WHEN 'fire_all' THEN m.back <= 100 ELSE false END),
numbered AS (SELECT c.*, row_number() OVER (PARTITION BY c.id ORDER BY c.f) AS nth FROM chosen c),
kept AS (SELECT n.id, n.f FROM numbered n JOIN r ON r.id = n.id WHERE n.nth <= 1000 AND n.nth <= r.remaining AND (r.end_at IS NULL OR n.f <= r.end_at) AND NOT (r.end_at IS NOT NULL AND r.next_fire_at > r.end_at)),
fires AS (SELECT id, f FROM kept UNION ALL SELECT id, next_fire_at FROM r WHERE kind = 'fixed_delay' AND remaining > 0 AND (end_at IS NULL OR next_fire_at <= end_at))
"""
FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform({bytes}, lambda b: CAST(b AS HUGEINT))), lambda h, b: ((h - h % 256 + xor(h % 256, b)) * 1099511628211) % 18446744073709551616)"
HASH = FNV.format(bytes="list_concat(list_transform(range(1, length(k) + 1), lambda i: ord(substring(k, i, 1))), list_transform(range(7, -1, -1), lambda i: CAST((n >> i * 8) & 255 AS INT)))")


@query(
    PLAN
    + f""", n AS (SELECT f.id, f.f, CAST(f.id AS VARCHAR) AS k, f.f * 1000 AS n, coalesce(r.jitter_ms, 0) AS w FROM fires f JOIN r ON r.id = f.id WHERE (f.id, f.f) NOT IN (SELECT schedule_id, fire_time FROM all_jobs WHERE schedule_id IS NOT NULL))
    SELECT id AS schedule_id, f AS fire_time, f + CASE WHEN w > 0 THEN CAST({HASH} % w AS BIGINT) * 1000 ELSE 0 END AS run_at FROM n""",
    "schedules job_types all_jobs",
)
def materialize_fires(t: Tables) -> DataFrame:
    """New fires of due schedules, cron ones too, each with its jittered start; the ledger keeps one from firing twice."""
    new, _ = scheduling.materialize_due(t.schedules, t.job_types, t.all_jobs, NOW)
    return new.select("schedule_id", "fire_time", "run_at")


@query(
    PLAN
    + f""", planned AS (SELECT id, count(*) AS n, min(f) AS first_fire, max(f) AS last_fire FROM fires GROUP BY id),
    follow AS (SELECT g.id, min(g.f) AS f FROM grid g WHERE g.f > {HORIZON} GROUP BY g.id)
    SELECT r.id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_fires, r.fire_count + CAST(coalesce(p.n, 0) AS BIGINT) AS fire_count, p.first_fire, p.last_fire,
    CASE WHEN remaining <= 0 OR (end_at IS NOT NULL AND next_fire_at > end_at) THEN true WHEN kind = 'fixed_delay' THEN remaining = 1 ELSE coalesce(p.n, 0) >= remaining OR coalesce(w.f > end_at, false) END AS completed
    FROM r LEFT JOIN planned p ON p.id = r.id LEFT JOIN follow w ON w.id = r.id""",
    "schedules job_types",
)
def plan_schedules(t: Tables) -> DataFrame:
    due = t.schedules.where((F.col("state") == "ACTIVE") & (F.col("next_fire_at") <= HORIZON)).join(t.job_types.where("enabled").select("tenant_id", F.col("name").alias("job_type")), ["tenant_id", "job_type"], "left_semi")
    p = scheduling.plan(due, NOW)
    return p.select("id", "n_fires", (F.col("fire_count") + F.col("n_fires")).alias("fire_count"), F.array_min("fires").alias("first_fire"), F.array_max("fires").alias("last_fire"), "completed")


@query(
    PLAN + f"SELECT r.id, CASE WHEN r.kind = 'cron' THEN min(c.f) END AS next FROM r LEFT JOIN cron_fires c ON c.expr = r.expr AND c.f > {HORIZON} WHERE r.kind = 'cron' AND max_runs IS NULL AND end_at IS NULL GROUP BY r.id, r.kind",
    "schedules job_types",
)
def cron_cursors(t: Tables) -> DataFrame:
    """Where cron schedules without an end go on after a pass."""
    _, updates = scheduling.materialize_due(t.schedules.where("kind = 'cron' and max_runs is null and end_at is null"), t.job_types, t.all_jobs, NOW)
    return updates.select("id", "next")


@query(
    f"""WITH RECURSIVE {CRON_FIRES}, up AS (SELECT id, 0 AS nth, next_fire_at AS f, every, end_at, CASE WHEN kind = 'fixed_delay' THEN least(1, coalesce(max_runs - fire_count, 8)) ELSE least(8, coalesce(max_runs - fire_count, 8)) END AS n FROM schedules WHERE next_fire_at IS NOT NULL AND kind <> 'cron'
        UNION ALL SELECT id, nth + 1, f + every, every, end_at, n FROM up WHERE nth + 1 < n),
    c AS (SELECT s.id, row_number() OVER (PARTITION BY s.id ORDER BY c.f) - 1 AS nth, c.f, s.end_at, least(8, coalesce(max_runs - fire_count, 8)) AS n FROM schedules s JOIN cron_fires c ON c.expr = s.expr AND c.f >= s.next_fire_at AND c.f < s.next_fire_at + {20 * DAY})
    SELECT id AS schedule_id, nth, f AS fire_time FROM up WHERE n > 0 AND (end_at IS NULL OR f <= end_at) UNION ALL SELECT id, nth, f FROM c WHERE nth < n AND (end_at IS NULL OR f <= end_at)""",
    "schedules",
)
def upcoming_fires(t: Tables) -> DataFrame:
    return scheduling.upcoming(t.schedules, 8)


@query(
    """WITH runs AS (SELECT schedule_id, fire_time, lead(fire_time) OVER (PARTITION BY schedule_id ORDER BY fire_time) - fire_time AS gap FROM all_jobs WHERE schedule_id IS NOT NULL)
    SELECT schedule_id, min(gap) AS min_gap FROM runs GROUP BY ALL""",
    "all_jobs",
)
def min_gap(t: Tables) -> DataFrame:
    return scheduling.min_gap(t.all_jobs.where("schedule_id is not null"))


LEDGER = """runs AS (SELECT id, schedule_id, fire_time, state, run_at FROM jobs WHERE schedule_id IS NOT NULL)"""


def _runs(t: Tables) -> DataFrame:
    return t.jobs.where("schedule_id is not null").select("id", "schedule_id", "fire_time", "state", "run_at")


LATER = NOW + 500 * DAY


@query(
    f"""WITH {LEDGER} SELECT r.id, r.schedule_id, (SELECT count(*) FROM runs p WHERE p.schedule_id = r.schedule_id AND (p.fire_time, p.id) < (r.fire_time, r.id) AND p.state IN ('READY', 'RUNNING', 'RETRY_PENDING')) AS earlier_active,
    (SELECT count(*) FROM runs p WHERE p.schedule_id = r.schedule_id AND (p.fire_time, p.id) < (r.fire_time, r.id) AND p.state = 'SCHEDULED') AS earlier_waiting FROM runs r""",
    "jobs",
)
def earlier_runs(t: Tables) -> DataFrame:
    return scheduling.earlier_runs(_runs(t)).select("id", "schedule_id", "earlier_active", "earlier_waiting")


OVERLAP = f"""WITH {LEDGER},
due AS (SELECT r.*, s.overlap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY r.schedule_id) AS cnt FROM runs r JOIN schedules s ON s.id = r.schedule_id WHERE r.state = 'SCHEDULED' AND r.run_at <= {LATER} WINDOW w AS (PARTITION BY r.schedule_id ORDER BY r.fire_time, r.id)),
flags AS (SELECT d.schedule_id, EXISTS (SELECT 1 FROM runs p WHERE p.schedule_id = d.schedule_id AND (p.fire_time, p.id) < (d.fire_time, d.id) AND p.state IN ('READY', 'RUNNING', 'RETRY_PENDING')) AS active,
    EXISTS (SELECT 1 FROM runs p WHERE p.schedule_id = d.schedule_id AND (p.fire_time, p.id) < (d.fire_time, d.id) AND p.state = 'SCHEDULED') AS waiting FROM due d WHERE rn = 1),
decided AS (SELECT d.id, d.schedule_id, d.fire_time, d.run_at AS due_at, d.overlap, d.rn, d.cnt, f.active, CASE d.overlap WHEN 'allow' THEN 'PROMOTE'
    WHEN 'buffer_one' THEN CASE WHEN f.waiting THEN 'SKIP' WHEN d.rn + CAST(f.active AS INT) = 1 THEN 'PROMOTE' WHEN d.rn + CAST(f.active AS INT) = 2 THEN 'BUFFER' ELSE 'SKIP' END
    WHEN 'cancel_previous' THEN CASE WHEN d.rn < d.cnt THEN 'SUPERSEDED' ELSE 'PROMOTE' END
    ELSE CASE WHEN d.rn + CAST(f.active AS INT) = 1 THEN 'PROMOTE' ELSE 'SKIP' END END AS decision FROM due d JOIN flags f ON f.schedule_id = d.schedule_id)
"""


@query(OVERLAP + f"SELECT * EXCLUDE (due_at), CASE WHEN decision = 'BUFFER' THEN {LATER + 5 * SECOND} ELSE due_at END AS run_at FROM decided", "jobs schedules")
def overlap_decisions(t: Tables) -> DataFrame:
    return scheduling.overlap_decisions(_runs(t), t.schedules, LATER)


@query(
    OVERLAP
    + """SELECT r.id, CASE WHEN r.state = 'RUNNING' THEN 'REQUEST_CANCEL' ELSE 'CANCELLED' END AS action FROM runs r JOIN decided d ON d.schedule_id = r.schedule_id AND d.overlap = 'cancel_previous' AND d.decision = 'PROMOTE' AND d.active
    WHERE r.fire_time < d.fire_time AND r.state IN ('READY', 'RETRY_PENDING', 'RUNNING')""",
    "jobs schedules",
)
def superseded_runs(t: Tables) -> DataFrame:
    runs = _runs(t)
    return scheduling.superseded(runs, scheduling.overlap_decisions(runs, t.schedules, LATER))


@query(OVERLAP + "SELECT overlap, count(*) FILTER (WHERE decision = 'PROMOTE') AS promoted, count(*) FILTER (WHERE decision = 'SKIP') AS skipped, count(*) FILTER (WHERE decision = 'BUFFER') AS buffered, count(*) FILTER (WHERE decision = 'SUPERSEDED') AS superseded FROM decided GROUP BY ALL", "jobs schedules")
def promotion_counts(t: Tables) -> DataFrame:
    d = scheduling.overlap_decisions(_runs(t), t.schedules, LATER)
    is_ = lambda s: F.count_if(F.col("decision") == s)
    return d.groupBy("overlap").agg(is_("PROMOTE").alias("promoted"), is_("SKIP").alias("skipped"), is_("BUFFER").alias("buffered"), is_("SUPERSEDED").alias("superseded"))


@query("SELECT schedule_id, max(fire_time) AS last_fire FROM all_jobs WHERE schedule_id IS NOT NULL GROUP BY ALL", "all_jobs")
def last_fires(t: Tables) -> DataFrame:
    return scheduling.last_fires(t.all_jobs)


@query(f"SELECT schedule_id, count(*) AS withdrawn, min(fire_time) AS next_fire_at FROM jobs WHERE state = 'SCHEDULED' AND run_at > {NOW} AND schedule_id IS NOT NULL GROUP BY ALL", "jobs")
def withdraw_provisional(t: Tables) -> DataFrame:
    return scheduling.withdraw(t.jobs, NOW)


CRONS = ("*/15 * * * *", "0 9 * * 1-5", "30 2 1,15 * *", "0 0 13 * 5", "5/20 8-17 * * *")
WHEN = ("minute(f) % 15 = 0", "minute(f) = 0 AND hour(f) = 9 AND dayofweek(f) BETWEEN 1 AND 5", "minute(f) = 30 AND hour(f) = 2 AND day(f) IN (1, 15)", "minute(f) = 0 AND hour(f) = 0 AND (day(f) = 13 OR dayofweek(f) = 5)", "minute(f) IN (5, 25, 45) AND hour(f) BETWEEN 8 AND 17")


@query(
    f"""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2000-01-01 00:00:00', TIMESTAMP '2000-02-10 00:00:00', INTERVAL 1 MINUTE)) AS f),
    x AS (SELECT s.id, s.id % 5 AS k, {NOW} + (s.id % 50) * {DAY // 2} AS after FROM schedules s)
    SELECT x.id, epoch_us(m.f) AS fire_time FROM x JOIN m ON epoch_us(m.f) > x.after AND epoch_us(m.f) <= x.after + {2 * DAY} AND CASE x.k {" ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WHEN))} END""",
    "schedules",
)
def cron_fires_utc(t: Tables) -> DataFrame:
    k = F.element_at(F.array(*(F.lit(c) for c in CRONS)), (F.col("id") % 5 + 1).cast("int"))
    after = F.lit(NOW) + (F.col("id") % 50) * (DAY // 2)
    rows = t.schedules.select("id", k.alias("expr"), F.lit("UTC").alias("zone"), after.alias("after"), (after + 2 * DAY).alias("until"))
    return cron.fires(rows)


ZONES = ("America/New_York", "Europe/London", "Australia/Lord_Howe")
#: Minutes from UTC in each zone at the start of 2000, and its changes in that year: (instant, minutes from then on).
OFFSETS = {
    "America/New_York": (-300, (("2000-04-02 07:00:00", -240), ("2000-10-29 06:00:00", -300))),
    "Europe/London": (0, (("2000-03-26 01:00:00", 60), ("2000-10-29 01:00:00", 0))),
    "Australia/Lord_Howe": (660, (("2000-03-25 15:00:00", 630), ("2000-08-26 15:30:00", 660))),
}
_SPANS = [(k, at, was, now) for k, zone in enumerate(ZONES) for (at, now), was in zip(OFFSETS[zone][1], (OFFSETS[zone][0], *(o for _, o in OFFSETS[zone][1])))]
#: A zone's offset at each minute; a minute whose clock reading has been shown before does not fire, one at which the clock jumps ahead also has the readings in between.
READINGS = f"""moves(zone, turn, was, later) AS (VALUES {", ".join(f"({k}, TIMESTAMP '{at}', {was}, {now})" for k, at, was, now in _SPANS)}),
m AS (SELECT unnest(generate_series(TIMESTAMP '1999-12-31 00:00:00', TIMESTAMP '2001-01-03 00:00:00', INTERVAL 1 MINUTE)) AS f),
shown AS (SELECT z.zone, m.f, m.f + to_minutes(CAST(coalesce((SELECT max_by(v.later, v.turn) FROM moves v WHERE v.zone = z.zone AND v.turn <= m.f), z.first) AS INT)) AS w FROM m, (VALUES {", ".join(f"({k}, {OFFSETS[z][0]})" for k, z in enumerate(ZONES))}) z(zone, first)),
readings AS (SELECT zone, f, w FROM shown s WHERE NOT EXISTS (SELECT 1 FROM moves v WHERE v.zone = s.zone AND v.later < v.was AND s.f >= v.turn AND s.f < v.turn + to_minutes(v.was - v.later))
    UNION ALL SELECT zone, turn, turn + to_minutes(CAST(was + g AS INT)) FROM (SELECT zone, turn, was, unnest(range(0, greatest(later - was, 0))) AS g FROM moves) AS j)"""


@query(
    f"""WITH {READINGS}, hits AS (SELECT DISTINCT r.zone, k, epoch_us(r.f) AS f FROM readings r, (VALUES (0), (1), (2), (3), (4)) p(k) WHERE CASE k {" ".join(f"WHEN {k} THEN {w.replace('(f)', '(r.w)')}" for k, w in enumerate(WHEN))} END),
    x AS (SELECT id, id % 3 AS zone, id % 5 AS k, {NOW} + (id % 365) * {DAY} AS after FROM schedules)
    SELECT x.id, h.f AS fire_time FROM x JOIN hits h ON h.zone = x.zone AND h.k = x.k AND h.f > x.after AND h.f <= x.after + {DAY}""",
    "schedules",
)
def cron_fires_zones(t: Tables) -> DataFrame:
    """Fires in zones with summer time, over a day of the year for each schedule."""
    zone = F.element_at(F.array(*(F.lit(z) for z in ZONES)), (F.col("id") % 3 + 1).cast("int"))
    k = F.element_at(F.array(*(F.lit(c) for c in CRONS)), (F.col("id") % 5 + 1).cast("int"))
    after = F.lit(NOW) + (F.col("id") % 365) * DAY
    return cron.fires(t.schedules.select("id", k.alias("expr"), zone.alias("zone"), after.alias("after"), (after + DAY).alias("until")))


@query(
    """SELECT id, CASE WHEN id % 9 = 4 THEN 'unknown time zone ''Mars/Base''' WHEN id % 9 = 7 THEN 'unknown time zone ''Local''' END AS error FROM schedules WHERE id % 9 IN (4, 7)""",
    "schedules",
)
def cron_problems(t: Tables) -> DataFrame:
    """Rows that can't fire are told, and keep no other from firing."""
    zone = F.when(F.col("id") % 9 == 4, "Mars/Base").when(F.col("id") % 9 == 7, "Local").when(F.col("id") % 9 == 1, "").when(F.col("id") % 9 == 2, "UTC")
    return cron.problems(t.schedules.select("id", F.lit("@daily").alias("expr"), zone.alias("zone")))


@query(
    f"""WITH runs AS (SELECT id, CAST(schedule_id AS VARCHAR) AS k, fire_time * 1000 AS n FROM jobs WHERE schedule_id IS NOT NULL)
    SELECT id, CAST({HASH} % 30000 AS BIGINT) AS jitter_ms FROM runs""",
    "jobs",
)
def fire_jitter(t: Tables) -> DataFrame:
    """The same fire gets the same jitter every time."""
    return t.jobs.where("schedule_id is not null").select("id", hashing.jitter_ms(F.col("schedule_id").cast("string"), F.col("fire_time"), F.lit(30_000).cast("long")).alias("jitter_ms"))
