"""Thresholds per occupied cell: from its neighbourhood, from its ring, combined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.functions import coords
from fringeworks.schema import CELL, PAIR


def neighbourhood(cells: DataFrame, kernel: int, nsigma: float) -> DataFrame:
    """``cells`` with local_thr, the count-weighted mean over a kernel x kernel
    box of median + nsigma std, and n_neighbors, the occupied cells in it but the
    cell itself.

    Each cell is copied to the ``kernel`` columns whose boxes it is in; a range
    window along u then sums the box.  One shuffle, no join.
    """
    back, ahead = kernel // 2, kernel - kernel // 2 - 1
    copies = cells.withColumn("shift", F.explode(F.sequence(F.lit(-ahead), F.lit(back)))).withColumn("row_v", F.col("cell_v") + F.col("shift"))
    box = Window.partitionBy(*PAIR, "row_v").orderBy("cell_u").rangeBetween(-back, ahead)
    n = F.col("n").cast("double")
    total = F.sum(n).over(box)
    mean = F.sum(F.col("median") * n).over(box) / total + F.lit(float(nsigma)) * (F.sum(F.col("std") * n).over(box) / total)
    wide = copies.withColumns({"local_thr": mean.cast("float"), "n_neighbors": F.count("*").over(box) - 1})
    return wide.filter("shift = 0").drop("shift", "row_v")


def neighbour_map(cells: DataFrame, kernel: int, n: int) -> DataFrame:
    """(cell, n_neighbors) of every cell of the grid that has an occupied cell in its box,
    itself occupied or not; cells beyond the edge of the grid are left out.

    Each occupied cell counts for all cells whose boxes it is in, itself excepted.
    """
    back, ahead = kernel // 2, kernel - kernel // 2 - 1
    shift = lambda name: F.explode(F.sequence(F.lit(-ahead), F.lit(back))).alias(name)
    spread = cells.select(*CELL, shift("du")).select("*", shift("dv"))
    spread = spread.select(*PAIR, (F.col("cell_u") + F.col("du")).alias("cell_u"), (F.col("cell_v") + F.col("dv")).alias("cell_v"), ((F.col("du") != 0) | (F.col("dv") != 0)).cast("bigint").alias("one"))
    inside = spread.filter(F.col("cell_u").between(0, 2 * n) & F.col("cell_v").between(0, n))
    return inside.groupBy(*CELL).agg(F.sum("one").alias("n_neighbors"))


def rings(cells: DataFrame, cell_size: float, widths: tuple[float, ...], n: int) -> DataFrame:
    radius = coords.cell_radius(F.col("cell_u"), F.col("cell_v"), cell_size, n)
    return cells.withColumn("ring", coords.ring_index(radius, widths))


def annular(cells: DataFrame, nsigma: float) -> DataFrame:
    """``cells`` (with ring) and annular_thr, the ring's count-weighted mean.  The
    means are one row per window, correlation and ring, so they are broadcast."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    mean = F.sum(F.col("median") * n) / total + F.lit(float(nsigma)) * (F.sum(F.col("std") * n) / total)
    means = cells.groupBy(*PAIR, "ring").agg(mean.cast("float").alias("annular_thr"))
    return cells.join(F.broadcast(means), [*PAIR, "ring"])


def combine(cells: DataFrame, min_neighbors: int) -> DataFrame:
    """The lesser threshold; the ring's alone where neighbours are few."""
    few = F.col("n_neighbors") < min_neighbors
    return cells.withColumn("threshold", F.when(few, F.col("annular_thr")).otherwise(F.least("local_thr", "annular_thr")))


def thresholds(cells: DataFrame, cell_size: float, n: int, nsigma: float = 3.0, kernel: int = 5, widths: tuple[float, ...] = (3000.0, 3000.0, 6500.0), min_neighbors: int = 3) -> DataFrame:
    local = neighbourhood(cells, kernel, nsigma)
    return combine(annular(rings(local, cell_size, widths, n), nsigma), min_neighbors)
