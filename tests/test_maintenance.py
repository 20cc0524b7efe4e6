"""Maintenance passes over history folders and tables."""

from pyspark.sql import functions as F

from quillon.sources import history

S = 1_000_000
DAY = 86_400 * S
NOW = 20_000 * DAY + 5 * S


def test_days_are_made_once_and_read_as_empty(spark, tmp_path):
    path = str(tmp_path / "history")
    history.write(spark.createDataFrame([(1, NOW), (2, NOW - 3 * DAY)], "id long, finished_at long"), path)
    assert len(history.make_days(spark, path, NOW)) == 8  # today is there
    assert history.make_days(spark, path, NOW) == []
    assert len(history.make_days(spark, path, NOW + DAY)) == 1
    assert sorted(r["id"] for r in history.read(spark, path).collect()) == [1, 2]
    history.write(spark.createDataFrame([(3, NOW + DAY)], "id long, finished_at long"), path)
    assert history.read(spark, path).count() == 3
    assert len(history.make_days(spark, str(tmp_path / "new"), NOW)) == 9


def test_a_pass_goes_on_after_a_failure(spark, tmp_path):
    good, kept = str(tmp_path / "history"), {}
    history.write(spark.createDataFrame([(i, NOW - i * DAY) for i in range(6)], "id long, finished_at long"), good)
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id long, at long")

    def purge(name, stay):
        if name == "broken":
            raise OSError("disk")
        kept[name] = sorted(r["id"] for r in stay.collect())

    tables = {"broken": (rows, F.col("at") < 10), "old": (rows, F.col("at") < 10), "young": (rows, F.col("at") < 1)}
    report = history.maintain(spark, [good, "nowhere://x"], tables, purge, NOW, 3 * DAY)
    # days -5 and -4 ended before the cutoff, which lies within day -3
    assert (report["created"], report["dropped"]) == (7, 2)
    assert report["deleted"] == {"old": 1, "young": 0}
    assert kept == {"old": [2, 3]}
    assert set(report["failed"]) == {"make nowhere://x", "drop nowhere://x", "purge broken"}
    assert sorted(r["id"] for r in history.read(spark, good).collect()) == [0, 1, 2, 3]
