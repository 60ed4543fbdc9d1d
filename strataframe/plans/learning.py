"""Queries of gridding and machine learning (2.10). Oracles where the result does not depend on a library's path."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import tidy as t
from ..operators import gridding as G
from ..operators import learning as L
from .fixtures import GRID_SQL, SECTION_SQL, Catalog, deposits, grid, section, stations, table, wells
from .grids import KNN_SQL

C = Catalog()


def _points(spark, d):
    return deposits(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), "id")


def _targets(spark, d):
    return grid(spark, d).select((F.col("i").cast("long") * 50 + F.col("j")).alias("target"), "x", "y")


@C.add("station_cleanup", "WITH s AS (SELECT ((o_custkey * 37) % 1000)::DOUBLE AS x, ((o_orderkey * 91) % 1000)::DOUBLE AS y, o_totalprice AS v FROM orders) SELECT x, y, round(avg(v), 4) + 0.0 AS value FROM s GROUP BY x, y")
def station_cleanup(spark, d):
    return G.clean_stations(stations(spark, d), "x", "y", "value").select("x", "y", t("value", 4).alias("value"))


@C.add("nearest_grid", KNN_SQL + "SELECT t AS target, s_acctbal AS value FROM n JOIN supplier ON s_suppkey = id WHERE rank = 1")
def nearest_grid(spark, d):
    return G.nearest_grid(_targets(spark, d), _points(spark, d), "target", "id", "value", 600.0).select("target", "value")


@C.add("kriging")
def kriging(spark, d):
    r = G.kriging(_targets(spark, d), _points(spark, d), "target", "id", "value", 8, 600.0, "spherical", 1e5, 9e6, 1200.0)
    return r.select("target", t("value", 3).alias("value"), t("variance", 1).alias("variance"))


@C.add("cokriging")
def cokriging(spark, d):
    """Balances of the suppliers with a secondary variable that both they and the cells have."""
    near = lambda df: df.withColumn("second", F.sin(F.col("x") / 700) * 50 + F.col("y") / 100)
    r = G.cokriging(near(_targets(spark, d)), near(_points(spark, d)), "target", "id", "value", "second", 8, 600.0, "spherical", 1e5, 9e6, 1200.0)
    return r.select("target", t("value", 3).alias("value"))


@C.add("fill_nearest", f"WITH {GRID_SQL}, k AS (SELECT i, j, value FROM g WHERE band % 4 <> 0), n AS (SELECT g.i, g.j, k.value, row_number() OVER (PARTITION BY g.i, g.j ORDER BY (g.i - k.i) ** 2 + (g.j - k.j) ** 2, k.i, k.j) AS r FROM g JOIN k ON abs(g.i - k.i) <= 12 AND abs(g.j - k.j) <= 12 WHERE g.band % 4 = 0) SELECT i, j, value FROM k UNION ALL SELECT i, j, value FROM n WHERE r = 1")
def fill_nearest(spark, d):
    g = grid(spark, d).select("i", "j", F.when(F.col("band") % 4 != 0, F.col("value")).alias("value"))
    return G.fill_nearest(g, 100.0, 100.0)


@C.add("spline")
def spline(spark, d):
    r = G.radial_spline(_targets(spark, d), _points(spark, d), "target", "id", "value", 12, 600.0)
    return r.select("target", t("value", 2).alias("value"))


@C.add("pca")
def pca(spark, d):
    scores, _, _ = L.pca(grid(spark, d).select("i", "j", "value", "band", "zone"), ["value", "band", "zone"], 2)
    return scores.select("i", "j", t("pc1").alias("pc1"), t("pc2").alias("pc2"))


@C.add("kmeans")
def kmeans(spark, d):
    return L.kmeans(grid(spark, d).select("i", "j", "value", "band"), ["value", "band"], 4).select("i", "j", "zone")


@C.add("som")
def som(spark, d):
    """The best unit and the facies of every log sample."""
    return L.som_facies(wells(spark, d), ["gr", "phi", "rhob"], 3, 3, 4, 4).select("well", "seq", "som_node", "som_facies")


def _lithology(spark, d):
    """Classes with a round border, which no line separates; every seventh sample of a well is not labelled."""
    w = wells(spark, d)
    near = ((F.col("gr") - 70) / 25) ** 2 + ((F.col("phi") - 0.1) / 0.03) ** 2
    named = F.when(near < 1, "sand").when(near < 2.5, "silt").otherwise("shale")
    return w.withColumn("lithology", F.when(F.col("seq") % 7 != 0, named))


@C.add("svm")
def svm(spark, d):
    """The predicted class of every complete sample, labelled or not."""
    return L.classify(_lithology(spark, d), ["gr", "phi", "rhob"], "lithology").select("well", "seq", "lithology", "held_out", "predicted")


@C.add("svm_confusion")
def svm_confusion(spark, d):
    r = L.confusion(L.classify(_lithology(spark, d), ["gr", "phi"], "lithology", kernel="poly"), "lithology")
    return r.select("label", "predicted", "n", t("accuracy").alias("accuracy"))


def _layered(spark, d):
    """The traces as a section of layers: a running sum down each trace, summed over the four traces before it."""
    s = section(spark, d)
    down = Window.partitionBy("trace").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    line = F.floor(F.col("trace") / 512).cast("long")
    across = Window.partitionBy("line", "k").orderBy("i").rowsBetween(-3, 0)
    s = s.select(line.alias("line"), (F.col("trace") % 512).cast("long").alias("i"), F.col("k").cast("long").alias("k"), F.sum("amp").over(down).alias("v"))
    return s.select("line", "i", "k", F.sum("v").over(across).alias("value"))


def _throws(patches, size: int, throw: int):
    """Patches and the same with their second half moved down by a throw, labelled 0 and 1."""
    moved = F.transform("pixels", lambda v, n: F.when(F.floor(n / size) < size // 2, v).otherwise(F.get("pixels", (F.floor(n / size) * size + (n + size - throw) % size).cast("int"))))
    return patches.select("pixels", F.lit(0).alias("label")).unionByName(patches.select(moved.alias("pixels"), F.lit(1).alias("label")))


@C.add("fault_ml")
def fault_ml(spark, d):
    """Fault probability of the section, taught by its own patches without and with a throw."""
    s = _layered(spark, d)
    taught = _throws(L.patches(s, ["line"], "i", "k", "value", 16, 16), 16, 5)
    r = L.patch_probability(s, taught, ["line"], "i", "k", "value", 16, 8, (32,), 30)
    return r.select("line", "i", "k", "n", t("probability").alias("probability"))


@C.add("patch_cover", f"WITH {SECTION_SQL}, c AS (SELECT trace // 512 AS line, trace % 512 AS i, k, amp FROM tr), o AS (SELECT DISTINCT line, i - i % 8 AS pi FROM c), q AS (SELECT unnest(range(0, 64, 8)) AS pj), p AS (SELECT o.line, pi, pj, max(abs(amp)) AS m, sum(amp * ((c.i - pi) * 16 + c.k - pj)) AS s FROM o, q, c WHERE c.line = o.line AND c.i BETWEEN pi AND pi + 15 AND c.k BETWEEN pj AND pj + 15 GROUP BY o.line, pi, pj HAVING count(*) = 256) SELECT line, pi, pj, round(s / m, 4) + 0.0 AS moment FROM p")
def patch_cover(spark, d):
    """The overlapping patches of the section, each as the moment of its pixels."""
    s = section(spark, d).select(F.floor(F.col("trace") / 512).alias("line"), (F.col("trace") % 512).alias("i"), "k", "amp")
    p = L.patches(s, ["line"], "i", "k", "amp", 16, 8)
    return p.select("line", "pi", "pj", t(F.aggregate(F.transform("pixels", lambda v, n: v * n), F.lit(0.0), lambda a, v: a + v), 4).alias("moment"))


@C.add("rforest")
def rforest(spark, d):
    r, _ = L.forest_regression(wells(spark, d), ["gr", "rhob", "dt"], "phi", 10)
    return r.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), t(F.avg(F.abs(F.col("predicted") - F.col("phi")))).alias("mae"))


@C.add("window_picks")
def window_picks(spark, d):
    """Best sample of each trace by a perceptron on windows, taught by the largest samples of every second trace."""
    s = section(spark, d)
    top = s.groupBy("trace").agg(F.max_by("k", F.struct("amp", "k")).alias("top"))
    labelled = s.join(top, "trace").withColumn("label", F.when(F.col("trace") % 2 == 0, (F.col("k") == F.col("top")).cast("double")))
    p = L.window_probability(labelled, ["trace"], "k", "amp", "label", 3)
    return p.groupBy("trace").agg(F.max_by("k", F.struct("probability", -F.col("k"))).alias("pick"))
