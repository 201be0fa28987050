"""Samples and visibility tables derived from the generic test tables, by integer and
dyadic arithmetic that any engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeworks.operators.samples import explode_cube, flat_samples, project
from fringeworks.sources.visibilities import Dataset

FLAT_CELL, FLAT_N, FLAT_WIDTHS = 10.0, 10, (30.0, 30.0, 65.0)
CUBE_CELL, CUBE_N, CHANNELS, CORRELATIONS = 250.0, 11, 16, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, u, v, value) from events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("row_id"), (((e * 7919) % 801 - 400) / F.lit(4.0)).alias("u"), (((e * 104729) % 601 - 300) / F.lit(4.0)).alias("v"), F.col("value").cast("float").alias("value"))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_samples(flat_rows(spark, sf_dir), FLAT_CELL, FLAT_N)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of few large cells from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("spw_id"), F.lit(0).alias("corr"), (F.col("l_partkey") % 21).cast("int").alias("cell_u"), (F.col("l_suppkey") % 11).cast("int").alias("cell_v"), F.col("l_extendedprice").cast("float").alias("value")
    )


def windows(spark: SparkSession) -> DataFrame:
    spw = spark.range(2).select(F.col("id").cast("int").alias("spw_id"))
    freq = F.transform(F.sequence(F.lit(0), F.lit(CHANNELS - 1)), lambda i: F.lit(1.0e9) + F.col("spw_id") * F.lit(5.0e8) + i * F.lit(1.0e6))
    return spw.select("spw_id", freq.alias("chan_freqs"), F.element_at(freq, 1).alias("ref_freq"), F.lit(CHANNELS).alias("n_chan"), F.lit(CORRELATIONS).alias("n_corr"))


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested visibilities from embeddings, with a model of half the data's real part
    in the first channel."""
    k, at = F.col("vec_id"), lambda c, p, j: F.element_at("embedding", (c * CORRELATIONS + p) * 2 + j)
    over = lambda fn: F.transform(F.sequence(F.lit(0), F.lit(CHANNELS - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(CORRELATIONS - 1)), lambda p: fn(c, p)))
    return table(spark, sf_dir, "embeddings").select(
        k.alias("row_id"), F.floor(k / 8).cast("double").alias("time"), (k % 2).cast("int").alias("spw_id"), F.col("label").alias("field_id"),
        F.array(((k * 7919) % 4001 - 2000) / F.lit(4.0), ((k * 104729) % 3001 - 1500) / F.lit(4.0), F.lit(0.0)).alias("uvw"),
        over(lambda c, p: F.struct(at(c, p, 1).alias("re"), at(c, p, 2).alias("im"))).alias("data"),
        over(lambda c, p: F.struct((at(c, p, 1) * F.when(c == 0, F.lit(0.5)).otherwise(F.lit(0.0))).cast("float").alias("re"), F.lit(0.0).cast("float").alias("im"))).alias("model_data"),
        over(lambda c, p: (k * 31 + c * 7 + p * 3) % 20 == 0).alias("flag"),
    )


def antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.cast("int").alias("antenna_id"), ((s * 7919) % 1009).cast("double").alias("x"), ((s * 104729) % 2003).cast("double").alias("y"), ((s * 31) % 53).cast("double").alias("z"))


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(main_table(spark, sf_dir), windows(spark), antennas(spark, sf_dir))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_cube(main_table(spark, sf_dir), windows(spark))


def cube_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(cube(spark, sf_dir), "amplitude", CUBE_CELL, CUBE_N)


def timed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, time) in time order from orders."""
    order = Window.orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select((F.row_number().over(order) - 1).cast("bigint").alias("row_id"), F.unix_timestamp("o_orderdate").cast("double").alias("time"))
