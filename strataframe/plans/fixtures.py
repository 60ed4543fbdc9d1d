"""The driver's tables read as survey data, for the registered queries, and the same as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship

DX = DY = 100.0

GRID_SQL = "g AS (SELECT (p_partkey // 50)::INT AS i, (p_partkey % 50)::INT AS j, 100.0::DOUBLE * (p_partkey % 50) AS x, 100.0::DOUBLE * (p_partkey // 50) AS y, p_retailprice AS value, p_size::DOUBLE AS band, (p_size % 5)::DOUBLE AS zone FROM part)"
STATION_SQL = "s AS (SELECT o_orderkey AS id, ((o_custkey * 37) % 1000)::DOUBLE AS x, ((o_orderkey * 91) % 1000)::DOUBLE AS y, o_totalprice AS value FROM orders)"
SERIES_SQL = "e AS (SELECT user_id AS station, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS k, epoch_us(ts) / 1e6 AS t, value, event_type FROM events)"
SECTION_SQL = "tr AS (SELECT vec_id AS trace, unnest(range(64))::INT AS k, unnest(embedding)::DOUBLE AS amp, label AS cmp, 50.0::DOUBLE * (vec_id % 24 + 1) AS off FROM embeddings)"
WELL_SQL = "w AS (SELECT l_suppkey AS well, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)::INT AS seq, 2 * l_quantity + 20 AS gr, l_discount + 0.05 AS phi, l_extendedprice / 1000 AS rt, 2.65 - 8 * l_tax AS rhob, 60 + l_quantity AS dt FROM lineitem)"
DEPOSIT_SQL = "dep AS (SELECT s_suppkey AS id, ((s_suppkey * 613) % 5000)::DOUBLE AS x, ((s_suppkey * 389) % 4000)::DOUBLE AS y FROM supplier)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a grid of 50 columns; value is the price, band the size, zone the size modulo 5."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    i, j = F.floor(k / 50).cast("int"), (k % 50).cast("int")
    return p.select(F.lit("part").alias("grid_id"), i.alias("i"), j.alias("j"), (j * DX).alias("x"), (i * DY).alias("y"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("band"), (F.col("p_size") % 5).cast("double").alias("zone"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as stations."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 37 % 1000).cast("double").alias("x"), (F.col("o_orderkey") * 91 % 1000).cast("double").alias("y"), F.col("o_totalprice").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one irregular series for each user; t in seconds, k counts from 0."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    return e.select(F.col("user_id").alias("station"), k.alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_type")


def section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as traces of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("trace"), F.posexplode("embedding").alias("k", "amp"), F.col("label").alias("cmp"), (50.0 * (F.col("vec_id") % 24 + 1)).alias("off")).withColumn("amp", F.col("amp").cast("double"))


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as logs, one well for each supplier."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return l.select(F.col("l_suppkey").alias("well"), seq.alias("seq"), (2 * F.col("l_quantity") + 20).alias("gr"), (F.col("l_discount") + 0.05).alias("phi"), (F.col("l_extendedprice") / 1000).alias("rt"), (2.65 - 8 * F.col("l_tax")).alias("rhob"), (60 + F.col("l_quantity")).alias("dt")).withColumn("depth", 1500 + 0.5 * F.col("seq"))


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as points."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 613 % 5000).cast("double").alias("x"), (F.col("s_suppkey") * 389 % 4000).cast("double").alias("y"))


class Catalog:
    """Registered queries and the SQL that checks them."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put
