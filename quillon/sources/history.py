"""History tables in daily partitions: written, listed, made ahead, dropped; a maintenance pass."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY = 86_400_000_000
PARTITION = "finished_day"
#: Days around today that a maintenance pass makes.
BACK, AHEAD = 1, 7


def _day(at: str):
    """The UTC day of an instant, whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(at) / DAY).cast("int")), "yyyyMMdd")


def write(rows: DataFrame, path: str, at: str = "finished_at") -> None:
    """Appends rows to the partition of the UTC day on which they ended; rows without an end go to the default one."""
    rows.withColumn(PARTITION, _day(at)).write.mode("append").partitionBy(PARTITION).parquet(path)


def rewrite_days(rows: DataFrame, path: str, at: str = "finished_at") -> None:
    """Replaces the days that occur in ``rows``, no others."""
    rows.withColumn(PARTITION, _day(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A filter on ``finished_day`` reads only those days."""
    return spark.read.parquet(path).withColumn(PARTITION, F.col(PARTITION).cast("string"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Days that have a partition, oldest first, without the default one: a listing of folders, at most one a day."""
    p, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    days = [n.partition("=")[2] for n in names if n.startswith(PARTITION + "=")]
    return sorted(d for d in days if len(d) == 8 and d.isdigit())


def _name(at: int) -> str:
    return datetime.fromtimestamp(at // 1_000_000, timezone.utc).strftime("%Y%m%d")


def make_days(spark: SparkSession, path: str, now: int, back: int = BACK, ahead: int = AHEAD) -> list[str]:
    """Makes the folders of the days around an instant; returns those that were not there. Readers pass over empty ones."""
    p, fs = _fs(spark, path)
    known = set(partitions(spark, path)) if fs.exists(p) else set()
    new = [d for d in (_name(now + n * DAY) for n in range(-back, ahead + 1)) if d not in known]
    for day in new:
        fs.mkdirs(_fs(spark, f"{path}/{PARTITION}={day}")[0])
    return new


def drop_before(spark: SparkSession, path: str, cutoff: int) -> list[str]:
    """Drops the days that ended before an instant; no row is read."""
    gone = [d for d in partitions(spark, path) if d < _name(cutoff)]
    for day in gone:
        p, fs = _fs(spark, f"{path}/{PARTITION}={day}")
        fs.delete(p, True)
    return gone


def maintain(spark: SparkSession, paths: list[str], tables: dict[str, tuple[DataFrame, Column]], purge, now: int, keep: int) -> dict:
    """One maintenance pass: makes days ahead in the history folders, drops those that are older than ``keep``, purges tables.

    tables: what goes of each (rows, condition). purge(name, kept rows) rewrites a table and is called only where some
    rows go; a condition that is null keeps its row. A task that fails leaves the others to run: the report holds the
    days made and dropped, the rows deleted of each table, and what failed.
    """
    from quillon.operators import lists

    report: dict = {"created": 0, "dropped": 0, "deleted": {}, "failed": {}}

    def task(name: str, run) -> None:
        try:
            run()
        except Exception as e:  # noqa: BLE001  whatever fails is tried again by the next pass
            report["failed"][name] = f"{type(e).__name__}: {e}"

    def make(path: str) -> None:
        report["created"] += len(make_days(spark, path, now))

    def drop(path: str) -> None:
        report["dropped"] += len(drop_before(spark, path, now - keep))

    def clean(name: str) -> None:
        rows, gone = tables[name]
        stay, go = lists.move(rows, gone)
        n = go.count()
        if n:
            purge(name, stay)
        report["deleted"][name] = n

    for path in paths:
        task(f"make {path}", lambda: make(path))
    for path in paths:
        task(f"drop {path}", lambda: drop(path))
    for name in tables:
        task(f"purge {name}", lambda: clean(name))
    return report
