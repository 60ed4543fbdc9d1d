"""Scans and sinks of survey files: delimited tables, well logs, trace matrices, grids, history and project stores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUFFIXES = (".csv", ".txt", ".xyz", ".dat")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A directory or file of delimited survey tables; comment lines start with #, the first line names the columns.

    The separator is found in the first line that is no comment. Column names lose blanks and a byte-order mark; column
    survey holds each row's file. An empty input or another suffix is an error.
    """
    if re.search(r"\.\w+$", path) and not path.lower().endswith(SUFFIXES):
        raise ValueError(f"not a survey table: {path}")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).limit(1).collect()
    if not lines:
        raise ValueError(f"nothing in {path}")
    head = lines[0][0]
    sep = max((",", ";", "\t"), key=head.count)
    if not head.count(sep):
        sep = " "
    raw = spark.read.option("comment", "#").option("sep", sep).option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    d = raw.withColumn("survey", F.col("_metadata.file_path"))
    return d.toDF(*[c.replace("﻿", "").strip() for c in raw.columns], "survey")


def read_las(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """well, seq, curve, value of a directory of LAS 2.0 files, wrapped or not; the file's NULL value is null.

    Each file is one row until its values are exploded, numbered over the file, so wrapping does not matter and nothing is
    sorted or shuffled. Sections of one letter are read one after the other. well is the file's path. With a separator a
    file holds many logs, each ended by it; then well is the log's WELL entry, and a log without one is left out.
    """
    read = spark.read.text(path, wholetext=True) if separator is None else spark.read.option("lineSep", separator).text(path)
    files = read.select(F.col("_metadata.file_path").alias("well"), "value")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("#"))
    d = files.select("well", F.concat(F.lit("\n"), F.array_join(lines, "\n")).alias("_text"))
    d = d.withColumn("_sections", F.filter(F.split("_text", "\n~"), lambda s, n: n > 0))
    inside = lambda letter: F.flatten(F.transform(F.filter("_sections", lambda s: F.upper(F.substring(s, 1, 1)) == letter), lambda s: F.filter(F.split(s, "\n"), lambda l, n: n > 0)))
    entry = lambda name, pattern: F.get(F.transform(F.filter(inside("W"), lambda l: F.upper(l).startswith(name)), lambda l: F.regexp_extract(l, pattern, 1)), F.lit(0))
    null = entry("NULL", r"(-?\d+\.?\d*)\s*:")
    if separator is not None:
        d = d.withColumn("well", F.nullif(entry("WELL", r"^[^.]*\.\S*\s+(.*?)\s*:"), F.lit(""))).filter("well IS NOT NULL")
    curves = F.transform(inside("C"), lambda l: F.regexp_extract(l, r"^\s*([^.\s]+)", 1))
    values = F.filter(F.split(F.array_join(inside("A"), "\n"), r"\s+"), lambda v: v != "")
    d = d.select("well", null.alias("_n"), curves.alias("_curves"), values.alias("_values"))
    d = d.filter(F.size("_curves") > 0).select("well", F.expr("try_cast(_n AS DOUBLE)").alias("_null"), "_curves", F.size("_curves").alias("_width"), F.posexplode("_values").alias("_at", "_v"))
    return d.select("well", F.floor(F.col("_at") / F.col("_width")).alias("seq"), F.get("_curves", F.col("_at") % F.col("_width")).alias("curve"), F.nullif(F.expr("try_cast(_v AS DOUBLE)"), F.col("_null")).alias("value"))


def read_traces(spark: SparkSession, path: str, dt: float, spacing: float = 1.0) -> DataFrame:
    """section, trace, x, dt, amp (array by sample) of files that hold a samples x traces matrix."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("section"), "value")
    rows = files.select("section", F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("k", "line"))
    cells = rows.select("section", "k", F.posexplode(F.split(F.trim("line"), r"[,;\s]+")).alias("trace", "v"))
    amp = F.array_sort(F.collect_list(F.struct("k", F.expr("try_cast(v AS DOUBLE)").alias("a"))))["a"]
    return cells.groupBy("section", "trace").agg(amp.alias("amp")).select("section", "trace", (F.col("trace") * float(spacing)).alias("x"), F.lit(float(dt)).alias("dt"), "amp")


def write_grid(cells: DataFrame, path: str, layer: str, units: str) -> None:
    """Rows x, y, value, layer_name, units as CSV."""
    cells.select("x", "y", "value", F.lit(layer).alias("layer_name"), F.lit(units).alias("units")).write.csv(path, header=True)


def write_profile(profile: DataFrame, path: str, name: str, units: str) -> None:
    profile.select("distance", "value", F.lit(name).alias("profile_name"), F.lit(units).alias("units")).write.csv(path, header=True)


def section_table(samples: DataFrame, traces: list[int], dt: float) -> DataFrame:
    """A section in long form (trace, k, amp) as rows tr0..trN, time."""
    wide = samples.groupBy("k").pivot("trace", traces).agg(F.first("amp"))
    return wide.select(*[F.col(f"`{t}`").alias(f"tr{n}") for n, t in enumerate(traces)], (F.col("k") * dt).alias("time"))


def history_entry(cells: DataFrame, method: str, inputs: str, output: str, parameters: dict[str, str], seconds: float) -> DataFrame:
    """One row for the history table: what ran, and the statistics of its first grid."""
    made = [x for k, v in sorted(parameters.items()) for x in (F.lit(k), F.lit(str(v)))]
    return cells.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).select(
        F.lit(method).alias("method"), F.lit(inputs).alias("input"), F.lit(output).alias("output"), (F.create_map(*made) if made else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("parameters"), "min", "max", "mean", "std", F.lit(float(seconds)).alias("seconds"), F.current_timestamp().alias("at")
    )


def append_history(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").parquet(path)


def layer_report(layers: DataFrame, history: DataFrame) -> DataFrame:
    """Statistics of each layer joined to the last method that made it."""
    stats = layers.groupBy("grid_id").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    last = history.groupBy(F.col("output").alias("grid_id")).agg(F.max_by("method", "at").alias("method"))
    return stats.join(last, "grid_id", "left")


def unique_name(names: DataFrame, wanted: str) -> Column | str:
    """wanted, or wanted (2), (3)... if the table of names has it."""
    pattern = "^" + re.escape(wanted) + r"(?: \((\d+)\))?$"
    top = names.filter(F.col("name").rlike(pattern)).agg(F.max(F.when(F.col("name") == wanted, 1).otherwise(F.regexp_extract("name", pattern, 1).cast("int")))).first()[0]
    return wanted if top is None else f"{wanted} ({top + 1})"


def save_project(stores: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each store; a column seq keeps the order."""
    for name, df in stores.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_project(spark: SparkSession, path: str, stores: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in stores}
