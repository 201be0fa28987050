"""Reading a visibility data set: a folder of Parquet tables ``main``,
``spectral_window`` and ``antenna``.  spw_id stands for the data description id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeworks.functions.coords import SPEED_OF_LIGHT, half_size
from fringeworks.functions.quantity import subtract_cubes

#: Rows examined to tell whether a model column is in use.
MODEL_ROWS = 1000


@dataclass(frozen=True)
class Dataset:
    main: DataFrame
    windows: DataFrame
    antennas: DataFrame | None = None
    path: str | None = None


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    return Dataset(read("main"), read("spectral_window"), read("antenna"), path)


def row_count(data: Dataset) -> int:
    return data.main.count()


def scan(data: Dataset, spw_id: int | None = None) -> DataFrame:
    """Rows of one spectral window, or all; the filter reaches the Parquet scan."""
    return data.main if spw_id is None else data.main.filter(F.col("spw_id") == spw_id)


def iter_chunks(data: Dataset, chunk_size: int, spw_id: int | None = None) -> Iterator[pa.Table]:
    """The rows of one spectral window, or all, in row order, ``chunk_size`` numbers of rows
    at a time; so the caller holds one chunk, whatever the size of the table."""
    rows = scan(data, spw_id)
    first, last = rows.agg(F.min("row_id"), F.max("row_id")).first()
    for start in range(first, last + 1, chunk_size) if first is not None else ():
        part = rows.filter(F.col("row_id").between(start, start + chunk_size - 1)).orderBy("row_id").toArrow()
        if part.num_rows:
            yield part


def _in_use(main: DataFrame, column: str) -> bool:
    head = main.orderBy("row_id").limit(MODEL_ROWS).select(column)
    lit = F.exists(column, lambda row: F.exists(row, lambda z: F.hypot(z["re"].cast("double"), z["im"].cast("double")) > 0))
    return not head.filter(lit).isEmpty()


def resolve_column(main: DataFrame, requested: str = "auto") -> str:
    """The column, or difference of columns, that is flagged.  Auto prefers a
    residual, then data less a model in use, corrected data less it, and data."""
    if requested.lower() != "auto":
        return requested
    has = {c.lower() for c in main.columns}
    if "residual" in has:
        return "residual"
    if "model_data" in has and _in_use(main, "model_data"):
        if "data" in has:
            return "data-model"
        if "corrected_data" in has:
            return "corrected_data-model"
    return "data"


def with_values(main: DataFrame, column: str) -> DataFrame:
    """``main`` with the column named, or the difference, as ``z``."""
    name = column.lower()
    if name.endswith("-model"):
        return main.withColumn("z", subtract_cubes(F.col(name.removesuffix("-model")), F.col("model_data")))
    return main.withColumn("z", F.col(name))


def max_baseline(antennas: DataFrame) -> DataFrame:
    """One row: the longest distance between two antennas.  The table is the
    array's hardware, a few hundred rows at most, and the pairs are its baselines."""
    a = antennas.select("antenna_id", "x", "y", "z")
    b = a.select(*[F.col(c).alias(f"{c}2") for c in a.columns])
    apart = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    return a.join(b, F.col("antenna_id") < F.col("antenna_id2")).agg(F.coalesce(F.max(F.sqrt(apart)), F.lit(0.0)).alias("max_baseline_m"))


def geometry_half_size(data: Dataset, cell_size: float, spw_ids: tuple[int, ...] | None = None) -> int:
    windows = data.windows if spw_ids is None else data.windows.filter(F.col("spw_id").isin(*spw_ids))
    top = windows.agg(F.max(F.array_max("chan_freqs"))).first()[0]
    if top is None:
        raise ValueError(f"no spectral window among {spw_ids}")
    if data.antennas is None:
        raise ValueError("without an antenna table the grid needs a uvrange")
    return half_size(max_baseline(data.antennas).first()[0] * top / SPEED_OF_LIGHT, cell_size)


def time_boundaries(main: DataFrame) -> DataFrame:
    """(time, first_row, next_row, n_rows) of each integration, in row order.  One row per integration
    is left when the single-partition window runs."""
    steps = main.groupBy("time").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n_rows"))
    order = Window.orderBy("first_row")
    return steps.withColumn("next_row", F.lead("first_row").over(order)).select("time", "first_row", "next_row", "n_rows")


def row_chunks(main: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, start_row, n_rows): at most ``n_chunks`` ranges of rows, none of
    which splits an integration where rows are in time order; the last takes the rest."""
    steps = main.groupBy("time").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n_rows"))
    every = Window.partitionBy()
    counted = steps.withColumns({"rank": F.row_number().over(Window.orderBy("first_row")) - 1, "n_steps": F.count("*").over(every), "total": F.sum("n_rows").over(every)})
    per = F.when(F.col("n_steps") <= n_chunks, F.lit(1)).otherwise(F.expr(f"n_steps div {int(n_chunks)}"))
    chunk = F.least(F.floor(F.col("rank") / per), F.least(F.col("n_steps"), F.lit(int(n_chunks))) - 1).cast("int")
    starts = counted.withColumn("chunk", chunk).groupBy("chunk").agg(F.min("first_row").alias("start_row"), F.min("total").alias("total"))
    after = F.lead("start_row").over(Window.orderBy("start_row"))
    return starts.select("chunk", "start_row", (F.coalesce(after, "total") - F.col("start_row")).alias("n_rows"))
