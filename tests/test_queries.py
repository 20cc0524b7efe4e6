"""Every query over the scheduling tables against its SQL, and what has no SQL for its shape."""

import oracle
import pytest

from quillon.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.compare(registry.queries()[name](spark, sf), con, SQL[name]) == ""


def test_entry_names_every_query(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_stream_bucket_equals_batch_fold(spark, sf):
    from pyspark.sql import functions as F

    from quillon.operators import admission

    q = registry.queries()
    stream = {r["tenant_id"]: (r["asked"], r["allowed"]) for r in q["stream_token_bucket"](spark, sf).collect()}
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select((F.col("user_id") % 25).cast("int").alias("tenant_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), (F.lit(1.0) / 43200.0).alias("rate"))
    out = admission.token_bucket(rows, "tenant_id", "rate", burst=86400.0).groupBy("tenant_id").agg(F.count("*").alias("asked"), F.count_if("allowed").alias("allowed"))
    assert stream == {r["tenant_id"]: (r["asked"], r["allowed"]) for r in out.collect()}
    assert any(asked > allowed for asked, allowed in stream.values())
