"""Validation and data quality of survey tables and grids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .aggregates import exact_percentiles, following

#: Functions that a map-algebra expression may use, by their Spark SQL names.
ALGEBRA = {"sqrt": "sqrt", "abs": "abs", "log": "ln", "log10": "log10", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "arctan": "atan", "arctan2": "atan2", "hypot": "hypot", "minimum": "least", "maximum": "greatest", "where": "if"}
_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<op>\*\*|<=|>=|==|!=|[-+*/%<>(),&|~]))")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; cells that do not parse are null and their rows stay. A missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: finite(F.expr(f"try_cast(`{c}` AS DOUBLE)")) for c in columns})


def quality_report(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """One row: rows, nulls over the three columns, (x, y) rows beyond the first, rows without a null."""
    null = lambda c: F.col(c).isNull().cast("long")
    complete = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()
    spots = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"), F.sum(null(x) + null(y) + null(value)).alias("nulls"), F.count_if(complete).alias("complete"))
    return spots.agg(F.sum("n").alias("n_rows"), F.sum("nulls").alias("n_nulls"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("complete").alias("n_complete"))


def _axis(df: DataFrame, c: str, tolerance: float) -> DataFrame:
    # A null is a value of its own, as it is for distinct(), and comes first.
    gaps = following(df.select(F.col(c).alias("v")).distinct(), "v", "v").select("v", (F.col("v") - F.col("p")).alias("gap"))
    middle = exact_percentiles(gaps, [], "gap", [0.5]).agg(F.max(F.col("p")[0]).alias("step"))
    close = F.abs(F.col("gap") - F.col("step")) <= tolerance * F.abs(F.col("step"))
    return gaps.crossJoin(F.broadcast(middle)).agg(F.count("v").alias("n"), F.max("step").alias("step"), F.coalesce(F.bool_and(F.when(F.col("gap").isNotNull(), close)), F.lit(True)).alias("even"))


def detect_regular_grid(df: DataFrame, x: str, y: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: nx, ny, dx, dy, n_points (distinct), n_missing and whether the points fill a regular grid."""
    full = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in (x, y, value)]).dropna()
    spots = full.groupBy(x, y).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    ax = _axis(full, x, tolerance).select(F.col("n").alias("nx"), F.col("step").alias("dx"), F.col("even").alias("ex"))
    ay = _axis(full, y, tolerance).select(F.col("n").alias("ny"), F.col("step").alias("dy"), F.col("even").alias("ey"))
    one = spots.crossJoin(ax).crossJoin(ay)
    cells = F.col("nx") * F.col("ny")
    regular = F.col("ex") & F.col("ey") & (cells == F.col("n_points")) & (F.col("n_points") == F.col("n_rows"))
    return one.select("nx", "ny", "dx", "dy", "n_points", F.greatest(cells - F.col("n_points"), F.lit(0)).alias("n_missing"), regular.alias("regular"))


def coordinate_warning(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: whether all finite coordinates could be degrees."""
    low, high = (lambda c: F.min(finite(c))), (lambda c: F.max(finite(c)))
    degrees = (low(x) >= -180) & (high(x) <= 180) & (low(y) >= -90) & (high(y) <= 90)
    return df.agg(low(x).alias("x_min"), high(x).alias("x_max"), low(y).alias("y_min"), high(y).alias("y_max"), F.coalesce(degrees, F.lit(False)).alias("looks_like_degrees"))


def fill_constant(cells: DataFrame, value: str = "value", constant: float = 0.0) -> DataFrame:
    return cells.withColumn(value, F.coalesce(finite(value), F.lit(constant)))


def reject_missing(cells: DataFrame, value: str = "value") -> DataFrame:
    """cells as they are; a missing value fails the job that reads them."""
    return cells.withColumn(value, F.when(F.isnotnull(finite(value)), F.col(value)).otherwise(F.raise_error(F.lit("missing value in grid")).cast("double")))


def crop_grid(cells: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Cells inside the bounds (inclusive, in either order), with i and j from 0 again."""
    (xmin, xmax), (ymin, ymax) = sorted((xmin, xmax)), sorted((ymin, ymax))
    inside = cells.filter(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
    first = inside.groupBy("grid_id").agg(F.min("i").alias("_i"), F.min("j").alias("_j"))
    return inside.join(first, "grid_id").withColumns({"i": F.col("i") - F.col("_i"), "j": F.col("j") - F.col("_j")}).drop("_i", "_j")


def crop_profile(profile: DataFrame, low: float, high: float) -> DataFrame:
    low, high = sorted((low, high))
    return profile.filter(F.col("distance").between(low, high))


def algebra_sql(expression: str, names: set[str]) -> str:
    """A checked map-algebra expression as Spark SQL. Only names, numbers, operators and ALGEBRA's functions pass."""
    out, at, text = [], 0, expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not allowed at {text[at:]!r}")
        at = m.end()
        call = text[at:].lstrip().startswith("(")
        if m["name"]:
            if call and m["name"] == "clip":
                out.append("strata_clip")
            elif call and m["name"] in ALGEBRA:
                out.append(ALGEBRA[m["name"]])
            elif not call and m["name"] in names:
                out.append(f"`{m['name']}`")
            elif not call and m["name"] in ("and", "or", "not"):
                out.append(m["name"])
            else:
                raise ValueError(f"unknown name {m['name']!r}")
        elif m["number"]:
            out.append(m["number"] + ("D" if "e" not in m["number"].lower() else ""))
        else:
            out.append({"&": " AND ", "|": " OR ", "~": " NOT ", "**": "**"}.get(m["op"], m["op"]))
    sql = " ".join(out)
    if "**" in sql:
        raise ValueError("write powers as products")
    return re.sub(r"strata_clip \( ([^(),]+) , ([^(),]+) , ([^(),]+) \)", r"greatest(least(\1, \3), \2)", sql)


def map_algebra(cells: DataFrame, expression: str, names: list[str], out: str = "value") -> DataFrame:
    """A column from an expression over the co-registered grids in the columns `names`."""
    return cells.withColumn(out, F.expr(algebra_sql(expression, set(names))).cast("double"))


def threshold_edges(c: Column, t: float = 0.5) -> Column:
    """1 where the value reaches t, else 0; null stays null."""
    if not 0 <= t <= 1:
        raise ValueError("threshold must be in 0..1")
    return (c >= t).cast("double")
