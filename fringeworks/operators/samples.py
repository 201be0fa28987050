"""From nested visibilities to one row per unflagged sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.functions import coords
from fringeworks.functions.quantity import check_quantity, quantity_of


def explode_cube(main: DataFrame, windows: DataFrame, column: str = "data") -> DataFrame:
    """(row_id, spw_id, field_id, uvw, chan, corr, freq, re, im, flag).

    Rows whose window is unknown are dropped by the join.  The window table has one
    row per spectral window of the receiver; Spark broadcasts it by its size.
    """
    freqs = windows.select("spw_id", "chan_freqs")
    rows = main.join(freqs, "spw_id").select("row_id", "spw_id", "field_id", "uvw", F.posexplode(F.arrays_zip(F.col(column).alias("z"), F.col("flag").alias("f"), F.col("chan_freqs").alias("freq"))).alias("chan", "c"))
    cells = rows.select("row_id", "spw_id", "field_id", "uvw", "chan", F.col("c.freq").alias("freq"), F.posexplode(F.arrays_zip(F.col("c.z").alias("z"), F.col("c.f").alias("f"))).alias("corr", "s"))
    return cells.select("row_id", "spw_id", "field_id", "uvw", "chan", "corr", "freq", F.col("s.z.re").alias("re"), F.col("s.z.im").alias("im"), F.col("s.f").alias("flag"))


def project(cube: DataFrame, quantity: str, cell_size: float, n: int, uvrange: tuple[float, float] | None = None) -> DataFrame:
    """Unflagged samples with folded coordinates in wavelengths, cell and value."""
    check_quantity(quantity)
    scaled = cube.filter(~F.coalesce(F.col("flag"), F.lit(False)))
    scaled = scaled.withColumns({"u0": coords.in_wavelengths(F.col("uvw")[0], F.col("freq")), "v0": coords.in_wavelengths(F.col("uvw")[1], F.col("freq"))})
    im = F.when(F.col("v0") < 0, -F.col("im")).otherwise(F.col("im"))
    folded = scaled.select("spw_id", "corr", "row_id", "chan", coords.fold(F.col("v0"), F.col("u0")).alias("u"), coords.fold(F.col("v0"), F.col("v0")).alias("v"), "re", im.alias("im"))
    if uvrange is not None:
        folded = folded.filter(coords.within_uvrange(F.col("u"), F.col("v"), uvrange))
    return folded.select(
        "spw_id", "corr", "row_id", "chan", "u", "v",
        coords.cell_u(F.col("u"), cell_size, n).alias("cell_u"), coords.cell_v(F.col("v"), cell_size).alias("cell_v"),
        quantity_of(F.col("re"), F.col("im"), quantity).alias("value"),
    )


def select_rows(main: DataFrame, spw_ids: tuple[int, ...] | None = None, field_ids: tuple[int, ...] | None = None) -> DataFrame:
    """Filters on plain columns, before any explode, so that the scan takes them."""
    if spw_ids is not None:
        main = main.filter(F.col("spw_id").isin(*spw_ids))
    if field_ids is not None:
        main = main.filter(F.col("field_id").isin(*field_ids))
    return main


def flat_samples(rows: DataFrame, cell_size: float, n: int) -> DataFrame:
    """Samples from rows (row_id, u, v, value) without channels: one window, one
    correlation."""
    u, v = coords.fold(F.col("v"), F.col("u")), coords.fold(F.col("v"), F.col("v"))
    return rows.select(
        F.lit(0).alias("spw_id"), F.lit(0).alias("corr"), "row_id", F.lit(0).alias("chan"), u.alias("u"), v.alias("v"),
        coords.cell_u(u, cell_size, n).alias("cell_u"), coords.cell_v(v, cell_size).alias("cell_v"), "value",
    )
