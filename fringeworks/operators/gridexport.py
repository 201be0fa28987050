"""Dense grids for diagnostics, from sparse cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.schema import CELL, PAIR


def dense_grid(cells: DataFrame, n: int) -> DataFrame:
    """Every cell of the grid for each window and correlation; an empty one has n
    0, median and std 0, and NaN for a threshold if there is one."""
    axis = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top)))
    frame = cells.select(*PAIR).distinct().withColumn("cell_u", axis(2 * n)).withColumn("cell_v", axis(n))
    columns = [F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("median", F.lit(0.0)).cast("float").alias("median"), F.coalesce("std", F.lit(0.0)).cast("float").alias("std")]
    if "threshold" in cells.columns:
        columns.append(F.coalesce("threshold", F.lit(float("nan"))).cast("float").alias("threshold"))
    return frame.join(cells, CELL, "left").select(*CELL, *columns)


def scale_range(before: DataFrame, after: DataFrame, column: str = "median") -> DataFrame:
    """(vmin, vmax) over both grids of what is shown: finite and not zero."""
    both = before.select(F.col(column).cast("double").alias("x")).union(after.select(F.col(column).cast("double").alias("x")))
    shown = both.filter("x is not null and x <> 0 and not isnan(x) and abs(x) < double('infinity')")
    return shown.agg(F.min("x").alias("vmin"), F.max("x").alias("vmax"))


def norm_of(vmin: float, vmax: float) -> dict:
    """A logarithmic scale for positive data, otherwise one linear around zero."""
    if vmin > 0:
        return {"kind": "log", "vmin": vmin, "vmax": vmax}
    return {"kind": "symlog", "linthresh": max(abs(vmin), abs(vmax)) * 1e-3 or 1.0, "vmin": vmin, "vmax": vmax}


def extent_in_kilolambda(n: int, cell_size: float) -> tuple[float, float, float, float]:
    side = n * cell_size / 1e3
    return (-side, side, 0.0, side)
