"""Metric series from text exposition files: a scan for Spark, a line at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A series line: name, labels in braces or none, value, a time that is ignored.
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI]nf|[nN]a[nN])"
LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{((?:[a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\]|\\.)*",?)*)\})?[ \t]+(' + NUMBER + r")(?:[ \t]+[0-9-]+)?[ \t]*$"


def unquote(text: Column) -> Column:
    r"""\\ , \" and \n as they were before they were escaped."""
    mark = "\x00"
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit(mark)), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))


def number(text: Column) -> Column:
    low = F.lower(text)
    special = F.when(low.rlike("^[+]?inf$"), float("inf")).when(low == "-inf", float("-inf")).when(low.rlike("nan$"), float("nan"))
    return F.coalesce(special, text.try_cast("double"))


def parse(lines: DataFrame, line: str = "value", strict: bool = True) -> DataFrame:
    """name, labels, value of each line that is no comment and not empty; other columns are kept. A malformed line is an error, or, unless strict, a row with its text in ``bad``."""
    text = F.trim(F.col(line))
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("__t", text)
    good = F.col("__t").rlike(LINE)
    body = F.regexp_extract("__t", LINE, 2)
    pairs = F.regexp_extract_all(body, F.lit(LABEL), F.lit(0))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, LABEL, 1).alias("key"), unquote(F.regexp_extract(p, LABEL, 2)).alias("value"))))
    fail = F.raise_error(F.concat(F.lit("malformed series: "), F.col("__t"))).cast("string")
    name = F.when(good, F.regexp_extract("__t", LINE, 1)).otherwise(fail if strict else F.lit(None))
    out = rows.withColumn("name", name).withColumn("labels", F.when(good, labels)).withColumn("value", F.when(good, number(F.regexp_extract("__t", LINE, 3))))
    return (out if strict else out.withColumn("bad", F.when(~good, F.col("__t")))).drop("__t", *([line] if line not in ("value",) else []))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, one a node; ``node`` is the file's name."""
    lines = spark.read.text(path).withColumn("node", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[a-z]+)?$", 1))
    return parse(lines)


def lines(series: DataFrame) -> DataFrame:
    """Series (name, labels, value) as lines of the text format: what ``parse`` reads gives the series again."""
    quoted = lambda t: F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"')))
    braces = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    inf = float("inf")
    number = F.when(F.col("value") == inf, "+Inf").when(F.col("value") == -inf, "-Inf").when(F.isnan("value"), "NaN").otherwise(F.col("value").cast("string"))
    return series.select(F.concat("name", braces, F.lit(" "), number).alias("value"))


def write(series: DataFrame, path: str) -> None:
    """One snapshot of all series as text files in a folder, which replaces the last one."""
    lines(series).write.mode("overwrite").text(path)
