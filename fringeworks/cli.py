"""Command line: ``python -m fringeworks SOURCE [options]``."""

from __future__ import annotations

import argparse
import os
import sys

from fringeworks.config import QUANTITIES, FlagConfig
from fringeworks.logs import setup_logging


def _uvrange(text: str) -> tuple[float, float]:
    parts = text.split(",")
    if len(parts) != 2:
        raise argparse.ArgumentTypeError("two comma-separated values are needed: UVMIN,UVMAX")
    return float(parts[0]), float(parts[1])


def _widths(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def parser() -> argparse.ArgumentParser:
    d = FlagConfig()
    p = argparse.ArgumentParser("fringeworks", description="Flag outliers of a visibility data set on the uv plane.")
    p.add_argument("source", nargs="?", help="folder with main, spectral_window and antenna tables")
    p.add_argument("--cell-size", type=float, default=d.cell_size, help="grid cell size in wavelengths")
    p.add_argument("--nsigma", type=float, default=d.nsigma)
    p.add_argument("--smoothing-window", type=int, default=d.smoothing_window)
    p.add_argument("--annulus-widths", type=_widths, default=d.annulus_widths, help="W1,W2,... in wavelengths")
    p.add_argument("--data-column", default=d.data_column)
    p.add_argument("--quantity", choices=QUANTITIES, default=d.quantity)
    p.add_argument("--cache-path", default=None, help="keep intermediate tables here")
    p.add_argument("--n-workers", type=int, default=d.n_workers)
    p.add_argument("--min-neighbors", type=int, default=d.min_neighbors)
    p.add_argument("--n-bins", type=int, default=d.n_bins)
    p.add_argument("--uvrange", type=_uvrange, default=None, help="UVMIN,UVMAX in wavelengths")
    p.add_argument("--spw", dest="spw_ids", type=int, action="append")
    p.add_argument("--field", dest="field_ids", type=int, action="append")
    p.add_argument("--plot-dir")
    p.add_argument("--persist-cache", action="store_true")
    p.add_argument("--plot-cached", help="plot from an existing cache; no data set is needed")
    p.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"], default="INFO")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    setup_logging(a.log_level)
    if a.plot_cached is not None:
        if a.plot_dir is None:
            p.error("--plot-cached needs --plot-dir")
        if "://" not in a.plot_cached and not os.path.exists(a.plot_cached):
            p.error(f"{a.plot_cached} does not exist")
    elif a.source is None:
        p.error("a source is needed unless --plot-cached is given")
    from fringeworks.plans import flagging_run, plots

    spark = flagging_run.local_session()
    if a.plot_cached is not None:
        made = plots.plot_from_cache(spark, a.plot_cached, a.plot_dir)
        print(f"{len(made)} plots from {a.plot_cached}")
    else:
        names = ("cell_size", "nsigma", "smoothing_window", "annulus_widths", "data_column", "quantity", "cache_path", "n_workers", "min_neighbors", "spw_ids", "field_ids", "uvrange", "n_bins", "plot_dir", "persist_cache", "log_level")
        result = flagging_run.flag_visibilities(spark, a.source, **{n: getattr(a, n) for n in names})
        made = result["plots"]
        print(f"Flagged {result['total_newly_flagged']} visibilities.")
        if result["cache_path"]:
            print(f"Cache: {result['cache_path']}")
    if made:
        print(f"Plots: {', '.join(made)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
