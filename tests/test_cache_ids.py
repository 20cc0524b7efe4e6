"""Reads through caches, and identifiers that sort by time."""

import random
import uuid

from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.operators import admission
from quillon.plans import registry


def walk(reads, values, ttl):
    """reads: (key, ts, id, ends); values: (key, at, value)."""
    held, out = {}, {}
    for key, ts, id_, ends in sorted(reads, key=lambda r: (r[0], r[1], r[2])):
        if key not in held or ts >= held[key][1]:
            now = max(((at, v) for k, at, v in values if k == key and at <= ts), key=lambda x: x[0], default=(None, None))[1]
            held[key] = ts, min(ts + ttl, ends) if ends is not None else ts + ttl, now
        out[key, id_] = held[key][0], held[key][2]
    return out


def test_cache_equals_a_walk(spark):
    rng = random.Random(3)
    reads = [(rng.choice("abc"), rng.randrange(300), i, None if rng.random() < 0.7 else rng.randrange(300)) for i in range(250)]
    values = [(k, at, rng.choice([None, at, -at])) for k in "abd" for at in rng.sample(range(300), 40)]
    r = spark.createDataFrame(reads, "key string, ts long, id long, ends long")
    v = spark.createDataFrame(values, "key string, at long, value long")
    for until, rows in (("ends", reads), (None, [(*x[:3], None) for x in reads])):
        got = {(x["key"], x["id"]): (x["fetched_at"], x["value"]) for x in admission.through_cache(r, v, 17, until).collect()}
        assert got == walk(rows, values, 17)
    assert admission.through_cache(r.limit(0), v, 17).count() == 0


def test_cached_quotas(spark, sf):
    """Nobody sees an answer that is half an hour old, and every value is that of the day on which it was fetched."""
    day, half = 86_400_000_000, 1_800_000_000
    rows = registry.queries()["cached_quotas"](spark, sf).collect()
    asked = {r["id"]: r for r in registry.Tables(spark, sf).submissions.select("id", "ts", "tenant_id").collect()}
    assert len(rows) == len(asked)
    want = walk([(str(a["tenant_id"]), a["ts"], i, None) for i, a in asked.items()], [], half)
    assert {(r["key"], r["id"]): r["fetched_at"] for r in rows} == {k: v[0] for k, v in want.items()}
    assert all(r["value"] == r["fetched_at"] // day for r in rows) and any(r["fetched_at"] < asked[r["id"]]["ts"] for r in rows)


def test_uuids(spark):
    rows = spark.createDataFrame([(1, 1_700_000_000_123_456, "1", "23"), (2, 1_700_000_000_123_999, "12", "3"), (3, 1_700_000_000_124_000, None, ""), (4, 0, "é", "z"), (5, None, "a", "b"), (6, 1_700_000_000_124_000, "", "")], "id long, at long, a string, b string")
    got = {r["id"]: r["u"] for r in rows.select("id", ids.uuid7(F.col("at"), F.col("a"), F.col("b")).alias("u")).collect()}
    assert got[5] is None and got[3] == got[6] and got[1][14:] != got[2][14:]
    for i, ms in ((1, 1_700_000_000_123), (2, 1_700_000_000_123), (3, 1_700_000_000_124), (4, 0)):
        u = uuid.UUID(got[i])
        assert str(u) == got[i] and u.version == 7 and u.variant == uuid.RFC_4122 and u.int >> 80 == ms
    assert got[4] < min(got[1], got[2]) < got[3]
    many = spark.range(5_000).select(ids.uuid7(F.lit(5_000), F.col("id")).alias("u"))
    assert many.distinct().count() == 5_000
