"""Queries of the sources and sinks (2.1): the driver's tables written as survey files and read back, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.iterate import shared_folder
from ..sources import surveys as X
from .fixtures import GRID_SQL, SECTION_SQL, STATION_SQL, WELL_SQL, Catalog, grid, section, stations, wells

C = Catalog()


def _folder(spark, name: str) -> str:
    """A new folder where all executors see it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@C.add("read_delimited", f"WITH {STATION_SQL} SELECT id, x, y, value FROM s")
def read_delimited(spark, d):
    path = _folder(spark, "delimited")
    stations(spark, d).select(F.col("id"), F.col("x").alias(" x"), "y", "value").write.option("sep", ";").option("header", True).csv(path)
    return X.read_delimited(spark, path).select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "value")])


@C.add("read_las", f"WITH {WELL_SQL} SELECT well::BIGINT AS well, seq - 1 AS seq, 'DEPT' AS curve, 1500 + 0.5 * seq AS value FROM w UNION ALL SELECT well, seq - 1, 'GR', gr FROM w UNION ALL SELECT well, seq - 1, 'PHI', CASE WHEN seq % 7 <> 0 THEN round(phi, 6) END FROM w")
def read_las(spark, d):
    """One log a well, many in a file, wrapped after each value; every seventh porosity is the log's NULL."""
    path = _folder(spark, "las")
    head = F.concat(F.lit("~Version\nVERS. 2.0 :\n~Well\nWELL. "), F.col("well").cast("string"), F.lit(" : well\nNULL. -999.25 : null value\n~Curve\nDEPT.M : depth\nGR.API : gamma\nPHI.V/V : porosity\n~A\n"))
    w = wells(spark, d).select("well", "seq", "depth", "gr", F.when(F.col("seq") % 7 == 0, -999.25).otherwise(F.round("phi", 6)).alias("phi"))
    row = F.concat_ws("\n", *[F.col(c).cast("string") for c in ("depth", "gr", "phi")])
    lines = w.groupBy("well").agg(F.array_sort(F.collect_list(F.struct("seq", row.alias("line")))).alias("rows"))
    text = F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    # A file a well would be made, named and listed one by one.
    lines.select(text.alias("value")).write.option("lineSep", "\x1e").text(path)
    back = X.read_las(spark, path, "\x1e")
    return back.select(F.col("well").cast("long").alias("well"), F.col("seq").cast("int").alias("seq"), "curve", F.col("value").cast("double").alias("value"))


@C.add("read_traces", f"WITH {SECTION_SQL}, n AS (SELECT trace, cmp, (row_number() OVER (PARTITION BY cmp ORDER BY trace) - 1)::INT AS place FROM (SELECT DISTINCT trace, cmp FROM tr)) SELECT tr.cmp::BIGINT AS cmp, place, 12.5 * place AS x, k, amp FROM tr JOIN n USING (trace)")
def read_traces(spark, d):
    """One samples x traces matrix for each cmp."""
    path = _folder(spark, "traces")
    rows = section(spark, d).groupBy("cmp", "k").agg(F.array_sort(F.collect_list(F.struct("trace", F.col("amp").cast("string").alias("a")))).alias("r"))
    line = F.array_join(F.transform("r", lambda r: r["a"]), ",")
    files = rows.groupBy("cmp").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("r"))
    files.select("cmp", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("value")).repartition("cmp").write.partitionBy("cmp").text(path)
    back = X.read_traces(spark, path, 0.004, 12.5).select(F.regexp_extract("section", r"cmp=(\d+)", 1).cast("long").alias("cmp"), F.col("trace").cast("int").alias("place"), "x", F.posexplode("amp").alias("k", "amp"))
    return back.select("cmp", "place", "x", F.col("k").cast("int").alias("k"), "amp")


@C.add("write_grid", f"WITH {GRID_SQL} SELECT x, y, value, 'price' AS layer_name, 'nT' AS units FROM g")
def write_grid(spark, d):
    path = _folder(spark, "grid")
    X.write_grid(grid(spark, d), path, "price", "nT")
    return spark.read.schema("x double, y double, value double, layer_name string, units string").csv(path, header=True)


@C.add("write_profile", f"WITH {GRID_SQL} SELECT x AS distance, value, 'row 1' AS profile_name, 'm' AS units FROM g WHERE i = 1")
def write_profile(spark, d):
    path = _folder(spark, "profile")
    X.write_profile(grid(spark, d).filter("i = 1").withColumn("distance", F.col("x")), path, "row 1", "m")
    return spark.read.schema("distance double, value double, profile_name string, units string").csv(path, header=True)


@C.add("layer_report", f"WITH {GRID_SQL} SELECT 'part' AS grid_id, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, 'flip' AS method FROM g")
def layer_report(spark, d):
    """Two runs of the history; the later one made the layer."""
    path, g = _folder(spark, "history"), grid(spark, d)
    X.append_history(X.history_entry(g, "upward", "raw", "part", {"height": "200"}, 1.5), path)
    X.append_history(X.history_entry(g, "flip", "part", "part", {}, 0.1), path)
    r = X.layer_report(g, spark.read.parquet(path))
    return r.select("grid_id", "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "method")


@C.add("project_store", f"WITH {STATION_SQL} SELECT id, x, y, value, 'stations' AS store, 3 AS version, 'm' AS units FROM s")
def project_store(spark, d):
    """Stations and the store's metadata, kept as JSON, saved and loaded."""
    path = _folder(spark, "project")
    meta = F.to_json(F.struct(F.lit("stations").alias("store"), F.lit(3).alias("version"), F.struct(F.lit("m").alias("x")).alias("units")))
    X.save_project({"stations": stations(spark, d).withColumn("meta", meta)}, path)
    back = X.load_project(spark, path, ["stations"])["stations"].withColumn("m", F.from_json("meta", "store string, version int, units struct<x:string>"))
    return back.select("id", "x", "y", "value", "m.store", "m.version", F.col("m.units.x").alias("units"))
