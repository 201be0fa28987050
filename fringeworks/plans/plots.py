"""Before and after grids as images.  Spark gives the cells of one grid at a time;
matplotlib draws them, and where it is missing the grids are written as NPZ."""

from __future__ import annotations

import logging
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.logs import NAME
from fringeworks.operators.gridexport import extent_in_kilolambda, norm_of
from fringeworks.schema import PAIR
from fringeworks.sources.cache import open_readonly

log = logging.getLogger(f"{NAME}.plots")


#: Pixels of a picture along either side at most.
SIDE = 2048


def _grid(cells: DataFrame, spw: int, corr: int, column: str, n: int) -> np.ndarray:
    """One (2N+1, N+1) grid, or where that is larger than a picture the means of square
    blocks of it, made by Spark; so what reaches the driver is bounded by SIDE."""
    step = -(-(2 * n + 1) // SIDE)
    own = cells.filter((F.col("spw_id") == spw) & (F.col("corr") == corr) & F.col("cell_u").between(0, 2 * n) & F.col("cell_v").between(0, n) & (F.col(column) != 0))
    block = lambda c: F.floor(F.col(c) / step).cast("int").alias(c)
    rows = own.groupBy(block("cell_u"), block("cell_v")).agg(F.mean(column).alias("value")).toPandas()
    out = np.full((2 * n // step + 1, n // step + 1), np.nan)
    out[rows.cell_u.to_numpy(), rows.cell_v.to_numpy()] = rows["value"].to_numpy()
    return out


def draw(before: np.ndarray, after: np.ndarray, title: str, cell_size: float, n: int, path: str) -> str | None:
    """The file written, or None where neither grid has anything to show."""
    shown = np.concatenate([before[np.isfinite(before)], after[np.isfinite(after)]])
    if not len(shown):
        log.warning("nothing to show in %s", path)
        return None
    scale, extent = norm_of(float(shown.min()), float(shown.max())), extent_in_kilolambda(n, cell_size)
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
        from matplotlib.colors import LogNorm, SymLogNorm
    except ImportError:
        path = path.removesuffix(".png") + ".npz"
        np.savez_compressed(path, before=before, after=after, extent=extent, **{f"norm_{k}": v for k, v in scale.items()})
        return path
    norm = LogNorm(scale["vmin"], scale["vmax"]) if scale["kind"] == "log" else SymLogNorm(scale["linthresh"], vmin=scale["vmin"], vmax=scale["vmax"])
    figure, axes = plt.subplots(2, 1, figsize=(12, 8), sharex=True, constrained_layout=True)
    for axis, grid, name in zip(axes, (before, after), ("before", "after"), strict=True):
        image = axis.imshow(grid.T, origin="lower", aspect="auto", extent=extent, norm=norm)
        axis.set(title=f"{title} {name} flagging", ylabel="v (kλ)")
    axes[1].set_xlabel("u (kλ)")
    figure.colorbar(image, ax=axes)
    figure.savefig(path, dpi=150)
    plt.close(figure)
    return path


def plot_cells(before: DataFrame, after: DataFrame, cell_size: float, n: int, plot_dir: str) -> list[str]:
    """Median and std of each window and correlation that has cells on both sides."""
    os.makedirs(plot_dir, exist_ok=True)
    pairs = before.select(*PAIR).distinct().join(after.select(*PAIR).distinct(), PAIR).orderBy(*PAIR).collect()
    made = []
    for spw, corr in pairs:
        for column in ("median", "std"):
            grids = (_grid(df, spw, corr, column, n) for df in (before, after))
            made.append(draw(*grids, f"spw {spw} corr {corr} {column}", cell_size, n, os.path.join(plot_dir, f"spw{spw}_corr{corr}_{column}.png")))
    return [p for p in made if p]


def plot_from_cache(spark: SparkSession, cache_path: str, plot_dir: str) -> list[str]:
    cache = open_readonly(spark, cache_path)
    if not (cache.has("cells") and cache.has("cells_after")):
        return []
    return plot_cells(cache.load("cells"), cache.load("cells_after"), cache.config().cell_size, (cache.grid_shape()[0] - 1) // 2, plot_dir)
