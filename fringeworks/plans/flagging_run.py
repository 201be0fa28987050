"""The whole run as one lazy plan over all windows and correlations."""

from __future__ import annotations

import logging
import time
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fringeworks.config import FlagConfig
from fringeworks.functions.coords import grid_shape, half_size
from fringeworks.functions.quantity import check_quantity
from fringeworks.logs import NAME, setup_logging
from fringeworks.operators import flagging, samples, stats, thresholds
from fringeworks.plans import plots
from fringeworks.sources.cache import ResultCache
from fringeworks.sources.visibilities import Dataset, geometry_half_size, open_dataset, resolve_column, with_values

log = logging.getLogger(f"{NAME}.run")


class FlagRun:
    """Lazy DataFrames of each step; ``cache`` makes them tables once computed."""

    def __init__(self, data: Dataset, config: FlagConfig, cache: ResultCache | None = None):
        check_quantity(config.quantity)
        if wrong := config.problems():
            raise ValueError("; ".join(wrong))
        self.data, self.config, self.cache = data, config, cache

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return df if self.cache is None else self.cache.store(name, df)

    @cached_property
    def column(self) -> str:
        return resolve_column(self.data.main, self.config.data_column)

    @cached_property
    def n(self) -> int:
        """Half size of the grid: from the uv range, or else from the antennas."""
        c = self.config
        if c.uvrange is not None:
            return half_size(c.uvrange[1], c.cell_size)
        return geometry_half_size(self.data, c.cell_size, c.spw_ids)

    @cached_property
    def samples(self) -> DataFrame:
        c = self.config
        rows = with_values(samples.select_rows(self.data.main, c.spw_ids, c.field_ids), self.column)
        cube = samples.explode_cube(rows, self.data.windows, "z")
        return self._kept("samples", samples.project(cube, c.quantity, c.cell_size, self.n, c.uvrange))

    @cached_property
    def cells(self) -> DataFrame:
        return self._kept("cells", stats.hybrid_stats(self.samples, self.config.n_bins))

    @cached_property
    def thresholds(self) -> DataFrame:
        c = self.config
        return self._kept("thresholds", thresholds.thresholds(self.cells, c.cell_size, self.n, c.nsigma, c.smoothing_window, c.annulus_widths, c.min_neighbors))

    @cached_property
    def n_cells(self) -> int | None:
        """The number of cells with a threshold, where that is a look at stored files."""
        return None if self.cache is None else self.thresholds.count()

    @cached_property
    def judged(self) -> DataFrame:
        return flagging.judged(self.samples, self.thresholds, self.n_cells)

    @cached_property
    def flags(self) -> DataFrame:
        return self._kept("flags", flagging.flags(self.samples, self.thresholds, self.n_cells))

    @cached_property
    def summary(self) -> DataFrame:
        return flagging.summary(self.judged)

    @cached_property
    def cells_after(self) -> DataFrame:
        return self._kept("cells_after", stats.hybrid_stats(flagging.inliers(self.samples, self.thresholds, self.n_cells), self.config.n_bins))

    @cached_property
    def merged(self) -> DataFrame:
        return flagging.merge_flags(self.data.main, self.flags)


def replace_main(spark: SparkSession, path: str, merged: DataFrame, ordered: bool = False) -> int:
    """Write ``merged`` beside the main table, counting new flags on the way, then swap
    the folders.  ``ordered`` writes the rows in ranges of row_id, each in order, at the
    price of another shuffle; scans of row ranges then read few files.

    A failure before the swap leaves the table as it was; a failed second rename puts the
    old folder back.  If the driver is lost between the two renames, the whole old table is
    in ``main.old-*`` and the whole new one in ``main.new-*``: rename either to
    ``main.parquet``.  Renames of folders are atomic on HDFS and local file systems, not
    in object stores.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    tag = uuid.uuid4().hex
    new, old, main = (hadoop(f"{path}/{x}") for x in (f"main.new-{tag}", f"main.old-{tag}", "main.parquet"))
    seen = Observation(f"flags-{tag}")
    out = merged.repartitionByRange("row_id").sortWithinPartitions("row_id") if ordered else merged
    out.observe(seen, F.sum("n_new").alias("n")).drop("n_new").write.parquet(new.toString())
    fs = main.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(main, old):
        raise OSError(f"cannot rename {main.toString()}")
    try:
        done = fs.rename(new, main)
    except Exception:
        fs.rename(old, main)
        raise
    if not done:
        fs.rename(old, main)
        raise OSError(f"cannot rename {new.toString()}")
    fs.delete(old, True)
    return int(seen.get["n"] or 0)


def write_flags(spark: SparkSession, path: str, new: DataFrame, ordered: bool = False) -> int:
    """Set the flags of ``new`` (row_id, chan, corr; a value beside them is not looked at)
    in the data set's main table, and give the number that were not set before.  No flag
    is ever cleared."""
    merged = flagging.merge_flags(spark.read.parquet(f"{path}/main.parquet"), new.select("row_id", "chan", "corr"))
    return replace_main(spark, path, merged, ordered)


def run(spark: SparkSession, source: str, config: FlagConfig, plot_dir: str | None = None, persist_cache: bool = False) -> dict:
    """Flag the data set in ``source`` in place.

    Intermediate tables go to ``cache_path`` and stay if that or
    ``persist_cache`` is given; otherwise to a folder beside the data set, removed
    at the end.
    """
    began = time.time()
    keep = persist_cache or config.cache_path is not None
    data = open_dataset(spark, source)
    plan = FlagRun(data, config)
    path = config.cache_path or f"{source.rstrip('/')}.cache-{uuid.uuid4().hex[:8]}"
    plan.cache = ResultCache(spark, path).create(source, config, grid_shape(plan.n), data.windows)
    log.info("column %s, grid %s", plan.column, grid_shape(plan.n))
    try:
        total = 0 if plan.flags.isEmpty() else replace_main(spark, source, plan.merged)
        made: list[str] = []
        if plot_dir is not None or keep:
            _ = plan.cells_after
        if plot_dir is not None:
            made = plots.plot_cells(plan.cells, plan.cells_after, config.cell_size, plan.n, plot_dir)
    finally:
        if not keep:
            plan.cache.delete()
    log.info("%d flags set", total)
    return {"source": source, "cache_path": path if keep else None, "grid_shape": grid_shape(plan.n), "total_newly_flagged": total, "elapsed_s": time.time() - began, "plots": made}


def flag_visibilities(
    spark: SparkSession,
    source: str,
    *,
    cell_size: float = 10.0,
    nsigma: float = 3.0,
    smoothing_window: int = 5,
    annulus_widths: tuple[float, ...] = (3000.0, 3000.0, 6500.0),
    data_column: str = "auto",
    quantity: str = "amplitude",
    cache_path: str | None = None,
    n_workers: int = 0,
    min_neighbors: int = 3,
    spw_ids: tuple[int, ...] | None = None,
    field_ids: tuple[int, ...] | None = None,
    uvrange: tuple[float, float] | None = None,
    n_bins: int = 256,
    plot_dir: str | None = None,
    persist_cache: bool = False,
    log_level: str = "INFO",
) -> dict:
    """Flag outliers of a data set on the uv plane; see ``run``.  ``n_workers`` is
    accepted for compatibility: the cluster decides."""
    setup_logging(log_level)
    pick = lambda x: None if x is None else tuple(x)
    config = FlagConfig(
        cell_size=cell_size, nsigma=nsigma, smoothing_window=smoothing_window, annulus_widths=tuple(annulus_widths), data_column=data_column, quantity=quantity,
        cache_path=cache_path, n_workers=n_workers, min_neighbors=min_neighbors, spw_ids=pick(spw_ids), field_ids=pick(field_ids), uvrange=pick(uvrange), n_bins=n_bins,
    )
    return run(spark, source, config, plot_dir, persist_cache)


def local_session(app: str = NAME) -> SparkSession:
    return SparkSession.builder.appName(app).getOrCreate()
