"""Helpers that the operators of this subpackage share.

Conventions that hold for every operator here:

* only the named input columns are read, so further columns, whatever their
  names, neither clash nor get lost where an operator passes rows through:
  columns that an operator needs on the way get names that no column has;
* no operator collects rows of the corpus to the driver; what is collected is
  a model or a histogram whose size has a stated bound;
* lineage is cut by writing Parquet to the folder that all executors share.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Characters that one numpy pass of an operator holds at once.
CHARS_AT_ONCE = 1_000_000

_written: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark's own reader from any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quillon-shared")


def _forget() -> None:
    for path, name in _written:
        try:
            path.getFileSystem(name).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing to delete through
            return


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget)
    jvm = spark.sparkContext._jvm
    folder = (jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration())
    _written.append(folder)
    found = spark.read.schema(df.schema).parquet(path)
    found.quillon_folder = folder
    return found


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which no plan may read any more; other frames are left alone."""
    folder = getattr(df, "quillon_folder", None)
    if folder in _written:
        _written.remove(folder)
        path, conf = folder
        path.getFileSystem(conf).delete(path, True)


#: Bounds of a batch for Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Batches of a few megabytes for Python, so that a worker's memory follows its longest texts, not its row count.

    Frames are run after the operator has returned, so the session keeps the bounds; they are only ever lowered.
    """
    for name, most in BATCH.items():
        now = spark.conf.get(name).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each changed until no column of ``taken`` has it in any case."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


#: Keys with more than this part of all rows are hot; there are at most as many as the inverse.
HOT_KEYS = 4_096


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined with facts (a row for each key, ``size``: how many rows the key has) on equal keys.

    Rows of hot keys, those with more than a 4,096th of ``total``, meet their facts by broadcast (fewer than 4,096 rows
    of facts) where they are; only the others are dealt out by key, so that no task gets a hot key's rows.
    """
    hot = facts.where(F.col(size) * HOT_KEYS > total)
    cold = facts.where(F.col(size) * HOT_KEYS <= total)
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(cold, on))


def with_columns(schema: T.StructType, **new: T.DataType) -> T.StructType:
    """``schema`` with new fields at its end; a field of the same name gives way to the new one."""
    kept = [f for f in schema.fields if f.name not in new]
    return T.StructType(kept + [T.StructField(k, v) for k, v in new.items()])


def append(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns but for those named in ``new``, then ``new``."""
    names = [n for n in batch.schema.names if n not in new]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(new.values()), names=names + list(new))


def hash_part(*cols: Column | str, parts: int = 1 << 40) -> Column:
    """A number below ``parts`` that depends on the columns only: the same rows are drawn at every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts).cast("long"))


def groups_by_size(sizes, most: int = CHARS_AT_ONCE):
    """Slices of consecutive items whose sizes sum to about ``most``; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
