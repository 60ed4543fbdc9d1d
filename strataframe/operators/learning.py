"""Machine learning over grids and logs with Spark's own library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PolynomialExpansion, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete rows with their columns as population z-scores named z_<column>; constant columns are 0."""
    full = df.dropna(subset=columns)
    s = full.agg(*[f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    d = full.crossJoin(F.broadcast(s))
    z = {f"z_{c}": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return d.withColumns(z).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def pca(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[list[float]], list[float]]:
    """Scores pc1..pck of complete rows, loadings and explained shares; a component's largest loading is positive."""
    z = _assembled(standardised(df, columns), [f"z_{c}" for c in columns])
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(z)
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, n]).argmax(), n] > 0 else -1.0 for n in range(k)]
    scores = model.transform(z).withColumn("_p", vector_to_array("pc"))
    out = scores.withColumns({f"pc{n + 1}": F.col("_p")[n] * signs[n] for n in range(k)}).drop("features", "pc", "_p", *[f"z_{c}" for c in columns])
    return out, [[float(load[r, n] * signs[n]) for n in range(k)] for r in range(len(columns))], [float(v) for v in model.explainedVariance]


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """Complete rows with column zone of k-means on z-scores."""
    z = _assembled(standardised(df, columns), [f"z_{c}" for c in columns])
    return KMeans(k=k, seed=seed, predictionCol="zone").fit(z).transform(z).drop("features", *[f"z_{c}" for c in columns])


def batch_som(df: DataFrame, columns: list[str], rows: int, cols: int, epochs: int = 10) -> list[list[float]]:
    """Prototypes (of z-scores) of a self-organising map by batch training: best units and neighbourhood sums are one aggregate a round."""
    from .iterate import dropped, written

    # Every round goes through the rows: equal ones are one, which weighs as many.
    rows_of = written(df.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    mean = rows_of.agg(*[F.sum(F.col(c) * F.col("_n")) / F.sum("_n") for c in columns]).first()
    away = rows_of.agg(*[F.when(F.min(c) < F.max(c), F.sqrt(F.sum((F.col(c) - F.lit(mean[k])) ** 2 * F.col("_n")) / F.sum("_n"))).otherwise(0.0) for k, c in enumerate(columns)]).first()
    z = rows_of.select("_n", *[((F.col(c) - mean[k]) / away[k] if away[k] else F.lit(0.0)).alias(c) for k, c in enumerate(columns)])
    spark, units = df.sparkSession, rows * cols
    low = z.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
    n = len(columns)
    w = [[low[c] + (low[n + c] - low[c]) * ((u // cols + (u % cols) * (c % 2)) / (rows + cols)) for c in range(n)] for u in range(units)]
    for e in range(epochs):
        radius = max(0.5, max(rows, cols) / 2 * (1 - e / epochs))
        sums = z.groupBy(best_unit(columns, w).alias("u")).agg(F.sum("_n").alias("n"), *[F.sum(F.col(c) * F.col("_n")).alias(c) for c in columns])
        near = spark.createDataFrame([(a, b, 2.718281828 ** (-((a // cols - b // cols) ** 2 + (a % cols - b % cols) ** 2) / (2 * radius * radius))) for a in range(units) for b in range(units)], "u int, v int, h double")
        new = sums.join(F.broadcast(near), "u").groupBy("v").agg(F.sum(F.col("h") * F.col("n")).alias("n"), *[F.sum(F.col("h") * F.col(c)).alias(c) for c in columns]).collect()
        for r in new:
            if r["n"] > 1e-12:
                w[r["v"]] = [r[c] / r["n"] for c in columns]
    dropped(rows_of)
    return w


def best_unit(columns: list[str], prototypes: list[list[float]]) -> Column:
    """The number of the nearest prototype, the first on ties. The prototypes are literals: a map has some dozens of units."""
    away = [F.struct(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, w, strict=True)), F.lit(0.0)).alias("d"), F.lit(u).alias("u")) for u, w in enumerate(prototypes)]
    return F.array_min(F.array(*away))["u"]


def som_facies(df: DataFrame, columns: list[str], rows: int = 5, cols: int = 5, facies: int = 5, epochs: int = 10, seed: int = 0) -> DataFrame:
    """df with som_node, the best unit of each row, and som_facies, the group of that unit by k-means over the prototypes.

    Facies are numbered from 0 by their smallest unit. Rows with a missing value in columns have nulls.
    """
    spark, n = df.sparkSession, len(columns)
    w = batch_som(df, columns, rows, cols, epochs)
    units = spark.createDataFrame([(u, *map(float, x)) for u, x in enumerate(w)], "u int, " + ", ".join(f"c{k} double" for k in range(n)))
    features = VectorAssembler(inputCols=[f"c{k}" for k in range(n)], outputCol="features").transform(units)
    groups = {r.u: r.g for r in KMeans(k=min(facies, rows * cols), seed=seed, predictionCol="g").fit(features).transform(features).select("u", "g").collect()}
    order = {g: k for k, g in enumerate(dict.fromkeys(groups[u] for u in range(rows * cols)))}
    s = df.dropna(subset=columns).agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    z = [f"_z{k}" for k in range(n)]
    scaled = df.withColumns({z[k]: (F.col(c) - s[2 * k]) / s[2 * k + 1] if s[2 * k + 1] else F.when(F.col(c).isNotNull(), 0.0) for k, c in enumerate(columns)})
    whole = F.lit(True)
    for c in z:
        whole = whole & F.col(c).isNotNull()
    named = F.array(*[F.lit(order[groups[u]]) for u in range(rows * cols)])
    out = scaled.withColumn("som_node", F.when(whole, best_unit(z, w)))
    return out.withColumn("som_facies", F.get(named, F.col("som_node"))).drop(*z)


def fourier_weights(n: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Turns (size, n) and shifts of features whose dot products are near exp(-gamma |x - y|**2) (Rahimi and Recht 2007)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, (2 * gamma) ** 0.5, (size, n)), rng.uniform(0.0, 2 * np.pi, size)


def random_fourier(columns: list[str], gamma: float, size: int, seed: int = 0) -> Column:
    """The features of fourier_weights() as one vector column."""
    w, b = fourier_weights(len(columns), gamma, size, seed)

    @F.pandas_udf("array<double>")
    def features(z: pd.DataFrame) -> pd.Series:
        return pd.Series(list(np.cos(z.to_numpy(float) @ w.T + b) * (2.0 / size) ** 0.5))

    return array_to_vector(features(F.struct(*columns)))


def fourier_margins(columns: list[str], gamma: float, size: int, seed: int, coefficients: np.ndarray, intercepts: np.ndarray) -> Column:
    """The number of the linear model (a row of coefficients) with the largest margin over these features, the first on ties."""
    w, b = fourier_weights(len(columns), gamma, size, seed)
    heights = coefficients.T * (2.0 / size) ** 0.5

    @F.pandas_udf("int")
    def largest(z: pd.DataFrame) -> pd.Series:
        return pd.Series(np.argmax(np.cos(z.to_numpy(float) @ w.T + b) @ heights + intercepts, axis=1).astype(np.int32))

    return largest(F.struct(*columns))


def classify(df: DataFrame, columns: list[str], label: str, test_share: float = 0.3, kernel: str = "rbf", c: float = 10.0, gamma: float | None = None, size: int = 128, seed: int = 0) -> DataFrame:
    """Complete rows with held_out (by hash within labels; null without a label) and the predicted label, one class against the rest.

    kernel: rbf by `size` random Fourier features (gamma: one over the number of columns), poly of degree 3, or linear.
    Rows without a label (null or empty) are predicted but teach nothing.
    """
    z = standardised(df, columns)
    known = F.col(label).isNotNull() & (F.col(label).cast("string") != "")
    z = z.withColumn("held_out", F.when(known, F.pmod(F.xxhash64(*columns, label), F.lit(1000)) < int(1000 * test_share)))
    names = [f"z_{c}" for c in columns]
    if kernel == "rbf":
        featured = lambda d: d.withColumn("features", random_fourier(names, gamma or 1.0 / len(columns), size, seed))
    elif kernel == "poly":
        featured = lambda d: PolynomialExpansion(degree=3, inputCol="_x", outputCol="features").transform(VectorAssembler(inputCols=names, outputCol="_x").transform(d)).drop("_x")
    elif kernel == "linear":
        featured = lambda d: _assembled(d, names)
    else:
        raise ValueError("kernel is rbf, poly or linear")
    taught = z.filter("NOT held_out")
    # Fitting keeps its rows, each with all features, in memory or on disk: equal rows are one, which weighs as many.
    taught = taught.groupBy(*columns, label).agg(F.count(F.lit(1)).cast("double").alias("_w"), *[F.first(f"z_{k}").alias(f"z_{k}") for k in columns])
    taught = featured(taught)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(taught)
    n = taught.agg(F.sum("_w")).first()[0] or 0
    svc = LinearSVC(maxIter=25, regParam=1.0 / (c * max(n, 1)))
    model = OneVsRest(classifier=svc, featuresCol="features", labelCol="_y", predictionCol="_p", weightCol="_w").fit(index.transform(taught))
    labels = F.array(*[F.lit(x) for x in index.labels])
    if kernel == "rbf":
        slopes, starts = np.array([m.coefficients.toArray() for m in model.models]), np.array([m.intercept for m in model.models])
        told = z.withColumn("_p", fourier_margins(names, gamma or 1.0 / len(columns), size, seed, slopes, starts))
    else:
        told = model.transform(featured(z))
    return told.withColumn("predicted", F.get(labels, F.col("_p").cast("int"))).drop("features", "_p", "rawPrediction", *names)


def confusion(predictions: DataFrame, label: str) -> DataFrame:
    """label, predicted, n and accuracy (of all) over the held-out rows of classify()."""
    held = predictions.filter("held_out")
    right = held.agg(F.avg((F.col(label).cast("string") == F.col("predicted")).cast("double")).alias("accuracy"))
    return held.groupBy(F.col(label).cast("string").alias("label"), "predicted").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(right))


def patches(cells: DataFrame, by: list[str], i: str, j: str, value: str, size: int = 16, stride: int = 4) -> DataFrame:
    """by, pi, pj, pixels: all whole size x size patches at multiples of stride, row after row (i), by their largest magnitude.

    Rows are dealt to the patches above them first, so that what is dealt again is a patch row's array, not single cells.
    """
    origins = lambda c: F.filter(F.sequence(F.greatest(F.floor((F.col(c) - size + stride) / stride), F.lit(0)), F.floor(F.col(c) / stride)), lambda o: o * stride + size > F.col(c))
    down = cells.filter(F.col(value).isNotNull()).withColumn("_pi", F.explode(origins(i)))
    columns = down.groupBy(*by, "_pi", j).agg(F.sort_array(F.collect_list(F.struct(F.col(i).alias("_i"), F.col(value).cast("double").alias("_v")))).alias("_c")).filter(F.size("_c") == size)
    across = columns.withColumn("_pj", F.explode(origins(j)))
    found = across.groupBy(*by, "_pi", "_pj").agg(F.sort_array(F.collect_list(F.struct(F.col(j).alias("_j"), F.col("_c._v").alias("_v")))).alias("_c")).filter(F.size("_c") == size)
    pixels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.transform("_c", lambda col: F.get(col["_v"], r))))
    largest = F.greatest(F.array_max(F.transform("_p", F.abs)), F.lit(1e-12))
    placed = found.select(*by, (F.col("_pi") * stride).alias("pi"), (F.col("_pj") * stride).alias("pj"), pixels.alias("_p"))
    return placed.select(*by, "pi", "pj", F.transform("_p", lambda v: v / largest).alias("pixels"))


def patch_probability(cells: DataFrame, labelled: DataFrame, by: list[str], i: str, j: str, value: str, size: int = 16, stride: int = 4, layers: tuple[int, ...] = (128, 32), iterations: int = 60, seed: int = 0) -> DataFrame:
    """by, i, j, probability, n: the mean over all n patches that hold a cell of the chance that a patch has a fault.

    labelled (pixels, label 0 or 1) is what the perceptron learns from, an input: patches of known sections. Cells in no
    whole patch have 0. A mean of a patch row is added up before its cells are, as the patches were dealt.
    """
    vector = lambda d: d.withColumn("features", array_to_vector(F.col("pixels").cast("array<double>")))
    model = MultilayerPerceptronClassifier(layers=[size * size, *layers, 2], labelCol="label", maxIter=iterations, seed=seed).fit(vector(labelled.withColumn("label", F.col("label").cast("double"))))
    scored = model.transform(vector(patches(cells, by, i, j, value, size, stride))).select(*by, "pi", "pj", vector_to_array("probability")[1].alias("_p"))
    rows = scored.withColumn("_j", F.explode(F.sequence("pj", F.col("pj") + size - 1))).groupBy(*by, "pi", "_j").agg(F.sum("_p").alias("_s"), F.count(F.lit(1)).alias("_n"))
    means = rows.withColumn("_i", F.explode(F.sequence("pi", F.col("pi") + size - 1))).groupBy(*by, F.col("_i").alias(i), F.col("_j").alias(j)).agg((F.sum("_s") / F.sum("_n")).alias("probability"), F.sum("_n").alias("n"))
    return cells.select(*by, i, j).join(means, [*by, i, j], "left").na.fill(0, ["n"]).na.fill(0.0, ["probability"])


def forest_regression(df: DataFrame, columns: list[str], target: str, trees: int = 50, test_share: float = 0.3, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Complete rows with a hold-out flag and predictions of a random forest, and the importances."""
    d = df.dropna(subset=[*columns, target]).withColumn("held_out", F.pmod(F.xxhash64(*columns, target), F.lit(1000)) < int(1000 * test_share))
    d = _assembled(d, columns)
    model = Pipeline(stages=[RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=6, seed=seed)]).fit(d.filter("NOT held_out"))
    return model.transform(d).drop("features"), [float(v) for v in model.stages[0].featureImportances]


def window_probability(df: DataFrame, by: list[str], at: str, value: str, label: str, half: int, seed: int = 0) -> DataFrame:
    """by, at, probability of label 1 by a perceptron on each sample's window (ends repeated), trained on labelled samples."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = []
    for o in range(-half, half + 1):
        taken = F.lead(value, o).over(w) if o > 0 else F.lag(value, -o).over(w) if o < 0 else F.col(value)
        df = df.withColumn(f"_w{o + half}", F.coalesce(taken, F.last(value).over(whole) if o > 0 else F.first(value).over(whole)))
        names.append(f"_w{o + half}")
    d = _assembled(df, names)
    model = MultilayerPerceptronClassifier(layers=[len(names), 8, 2], labelCol=label, maxIter=30, seed=seed).fit(d.filter(F.col(label).isNotNull()))
    return model.transform(d).select(*by, at, vector_to_array("probability")[1].alias("probability"))
