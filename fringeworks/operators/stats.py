"""Robust statistics per cell.

Small cells get the exact median and MAD; large ones quantiles of a histogram of
fixed range.  The histogram is a grouped count, combined on the map side to at most
``n_bins`` rows per cell and task, so a cell near the origin that holds most
samples costs its task no more than others.  The samples are read twice: for count and
range of each cell, and for the counts of bins and of small cells' values, which one
aggregation makes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.schema import CELL

#: Cells with at most this many samples are computed exactly.
EXACT = 32
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349


def _valid(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _sigma(mad: Column) -> Column:
    return (F.lit(MAD_TO_SIGMA).cast("float").cast("double") * mad).cast("float")


def count_min_max(samples: DataFrame) -> DataFrame:
    return _valid(samples).groupBy(*CELL).agg(F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))


def cell_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*CELL).agg(F.count("*").alias("n"))


def cell_offsets(counts: DataFrame, by: tuple[str, ...] = ("spw_id", "corr")) -> DataFrame:
    """Position of each cell's first sample when samples are in cell order.

    In two levels, so that no task sees more than one column of a grid or one row
    per column: sums of the columns before, and sums within the column.
    """
    preceding = (Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, "cell_u").agg(F.sum("n").alias("_n"))
    base = sums.select(*by, "cell_u", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("cell_u").rowsBetween(*preceding)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "cell_u").orderBy("cell_v").rowsBetween(*preceding)), F.lit(0))
    placed = counts.withColumn("_within", within).join(base, [*by, "cell_u"])
    return placed.withColumn("first", (F.col("_base") + F.col("_within")).cast("bigint")).select(*counts.columns, "first")


def exact_stats(samples: DataFrame) -> DataFrame:
    """n, median and 1.4826 MAD of every cell, whatever its size."""
    values = _valid(samples)
    centre = values.groupBy(*CELL).agg(F.count("*").alias("n"), F.median("value").cast("float").alias("median"))
    off = values.join(centre, CELL).withColumn("dev", F.abs(F.col("value").cast("double") - F.col("median")).cast("float"))
    spread = off.groupBy(*CELL, "n", "median").agg(F.median("dev").cast("float").alias("mad"))
    return spread.select(*CELL, "n", "median", _sigma(F.col("mad")).alias("std"))


def _middle(xs: Column) -> Column:
    """Median of a sorted array, as a float."""
    n = F.size(xs)
    low, high = F.element_at(xs, F.floor((n + 1) / 2).cast("int")), F.element_at(xs, F.floor(n / 2).cast("int") + 1)
    return ((low.cast("double") + high.cast("double")) / 2).cast("float")


def _range(vmin: Column, vmax: Column) -> tuple[Column, Column]:
    """Lower end and length of a cell's histogram."""
    lo, top = vmin.cast("double"), vmax.cast("double")
    return lo, F.when(top > lo, top).otherwise(lo + 1.0) - lo


def _bin(value: Column, lo: Column, length: Column, n_bins: int) -> Column:
    return F.least(F.greatest(F.floor((value.cast("double") - lo) / length * F.lit(n_bins)), F.lit(0)), F.lit(n_bins - 1)).cast("int")


def histogram(ranged: DataFrame, n_bins: int = 256) -> DataFrame:
    """(cell, n, lo, width, bin, k) from samples with their cell's n, vmin and vmax."""
    lo, length = _range(F.col("vmin"), F.col("vmax"))
    bin_ = _bin(F.col("value"), lo, length, n_bins)
    return ranged.select(*CELL, "n", lo.alias("lo"), (length / F.lit(float(n_bins))).alias("width"), bin_.alias("bin")).groupBy(*CELL, "n", "lo", "width", "bin").agg(F.count("*").alias("k"))


def quantiles(hist: DataFrame) -> DataFrame:
    """(cell, n, median, q1, q3, std): linear within the first bin whose running
    count reaches the rank."""
    run = Window.partitionBy(*CELL).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cum", F.sum("k").over(run))

    def at(share: float) -> Column:
        rank = F.col("n") * F.lit(share)
        value = F.col("lo") + (F.col("bin") + (rank - (F.col("cum") - F.col("k"))) / F.col("k")) * F.col("width")
        return F.min_by(F.when(F.col("cum") >= rank, value), F.when(F.col("cum") >= rank, F.col("bin")))

    q = cum.groupBy(*CELL, "n").agg(at(0.5).alias("q2"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    return q.select(*CELL, "n", F.col("q2").cast("float").alias("median"), "q1", "q3", ((F.col("q3") - F.col("q1")) / F.lit(IQR_TO_SIGMA)).cast("float").alias("std"))


def with_ranges(samples: DataFrame) -> DataFrame:
    """Valid samples with their cell's n, vmin and vmax."""
    values = _valid(samples)
    return values.join(count_min_max(samples), CELL)


def _quantiles(slots: Column, n: Column, lo: Column, width: Column, shares: tuple[float, ...]) -> Column:
    """A struct q0, q1, ... from a cell's sorted (slot, k), as ``quantiles`` has them."""
    names = [f"q{i}" for i in range(len(shares))]
    start = F.struct(F.lit(0).cast("bigint").alias("cum"), *[F.lit(None).cast("double").alias(q) for q in names])

    def step(a: Column, e: Column) -> Column:
        cum = a["cum"] + e["k"]
        at = lambda rank: lo + (e["slot"].cast("double") + (rank - a["cum"]) / e["k"]) * width
        found = [F.coalesce(a[q], F.when(cum >= n * F.lit(share), at(n * F.lit(share)))).alias(q) for q, share in zip(names, shares, strict=True)]
        return F.struct(cum.alias("cum"), *found)

    return F.aggregate(slots, start, step)


def hybrid_stats(samples: DataFrame, n_bins: int = 256) -> DataFrame:
    """n, median and std of every cell: exact for cells of at most EXACT samples, whose
    slots are their values, and from ``n_bins`` bins, the slots of the others."""
    ranges = count_min_max(samples)
    lo, length = _range(F.col("vmin"), F.col("vmax"))
    small = F.col("n") <= EXACT
    slot = F.when(small, F.col("value")).otherwise(_bin(F.col("value"), lo, length, n_bins).cast("float"))
    # The ranges are joined twice, to samples and to cells, from one exchange.
    slots = _valid(samples).join(ranges, CELL).select(*CELL, slot.alias("slot")).groupBy(*CELL, "slot").agg(F.count("*").alias("k"))
    cells = slots.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("slot", "k"))).alias("slots")).join(ranges, CELL)
    xs = F.flatten(F.transform("slots", lambda e: F.array_repeat(e["slot"], e["k"].cast("int"))))
    exact = cells.withColumn("xs", F.when(small, xs)).withColumn("middle", F.when(small, _middle(F.col("xs"))))
    off = F.sort_array(F.transform("xs", lambda x: F.abs(x.cast("double") - F.col("middle")).cast("float")))
    q = exact.withColumns({"sigma": F.when(small, _sigma(_middle(off))), "q": F.when(~small, _quantiles(F.col("slots"), F.col("n"), lo, length / F.lit(float(n_bins)), (0.25, 0.5, 0.75)))})
    median = F.when(small, F.col("middle")).otherwise(F.col("q.q1").cast("float"))
    std = F.when(small, F.col("sigma")).otherwise(((F.col("q.q2") - F.col("q.q0")) / F.lit(IQR_TO_SIGMA)).cast("float"))
    return q.select(*CELL, "n", median.alias("median"), std.alias("std"))


def cell_stats(samples: DataFrame, method: str = "hybrid", n_bins: int = 256) -> DataFrame:
    if method not in ("hybrid", "exact"):
        raise ValueError(f"Unknown method: {method!r}")
    return hybrid_stats(samples, n_bins) if method == "hybrid" else exact_stats(samples)
