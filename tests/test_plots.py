"""Pictures: what is drawn, and what is left out."""

import os

import numpy as np

from fringeworks import FlagConfig, FlagRun
from fringeworks.operators.gridexport import extent_in_kilolambda, norm_of
from fringeworks.plans import plots, profile
from fringeworks.plans.flagging_run import write_flags
from fringeworks.plans.plots import plot_cells
from fringeworks.sources.visibilities import Dataset

CELLS = "spw_id int, corr int, cell_u int, cell_v int, n bigint, median float, std float"


def test_norms_and_extents():
    assert norm_of(0.5, 8.0) == {"kind": "log", "vmin": 0.5, "vmax": 8.0}
    assert norm_of(-4.0, 2.0) == {"kind": "symlog", "linthresh": 0.004, "vmin": -4.0, "vmax": 2.0} and norm_of(0.0, 0.0)["linthresh"] == 1.0
    assert extent_in_kilolambda(50, 10.0) == (-0.5, 0.5, 0.0, 0.5)


def test_grids_written(spark, tmp_path, monkeypatch):
    """Two pairs of grids; a pair that one side lacks, and one of nothing but zeros, give none."""
    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name.startswith("matplotlib") else real(name, *a, **k))
    before = spark.createDataFrame([(0, 0, 5, 0, 9, 2.0, 1.0), (0, 0, 6, 3, 9, 4.0, 0.0), (0, 0, 99, 0, 9, 7.0, 1.0), (1, 0, 5, 0, 9, 1.0, 1.0), (2, 1, 5, 1, 9, 0.0, -3.0)], CELLS)
    after = spark.createDataFrame([(0, 0, 5, 0, 8, 1.5, 0.5), (2, 1, 5, 1, 9, 0.0, 3.0)], CELLS)
    made = plot_cells(before, after, 10.0, 5, str(tmp_path))
    assert sorted(map(os.path.basename, made)) == ["spw0_corr0_median.npz", "spw0_corr0_std.npz", "spw2_corr1_std.npz"]
    held = np.load(f"{tmp_path}/spw0_corr0_median.npz")
    want = np.full((11, 6), np.nan)
    want[5, 0], want[6, 3] = 2, 4
    assert np.array_equal(held["before"], want, equal_nan=True) and held["after"][5, 0] == 1.5 and np.isfinite(held["after"]).sum() == 1
    assert held["extent"].tolist() == [-0.05, 0.05, 0.0, 0.05] and str(held["norm_kind"]) == "log" and (held["norm_vmin"], held["norm_vmax"]) == (1.5, 4.0)
    assert str(np.load(f"{tmp_path}/spw2_corr1_std.npz")["norm_kind"]) == "symlog"


def test_large_grids_are_reduced(spark, monkeypatch):
    monkeypatch.setattr(plots, "SIDE", 4)
    cells = spark.createDataFrame([(0, 0, u, v, 1, float(u + v), 0.0) for u in range(9) for v in range(5)], CELLS)
    grid = plots._grid(cells, 0, 0, "median", 4)
    want = np.array([[np.mean([u + v for u in range(9) for v in range(5) if u // 3 == i and v // 3 == j and u + v]) for j in range(2)] for i in range(3)])
    assert grid.shape == (3, 2) and np.allclose(grid, want)


def test_profile_and_ordered_write(spark, tmp_path):
    cube = [[(1.0, 0.0), (1.0, 0.0)]] * 3
    rows = [(i, 0.0, 0, 0, [float(i), 2.0, 0.0], cube, [[False, False]] * 3) for i in range(40)]
    from fringeworks.schema import VISIBILITIES

    spark.createDataFrame(rows[::-1], VISIBILITIES).write.parquet(f"{tmp_path}/main.parquet")
    windows = spark.createDataFrame([(0, [1e9, 1.1e9, 1.2e9])], "spw_id int, chan_freqs array<double>")
    found = profile.profile(FlagRun(Dataset(spark.read.parquet(f"{tmp_path}/main.parquet"), windows), FlagConfig(cell_size=20.0, uvrange=(0.0, 300.0))), ("samples", "cells"))
    assert found["cells"]["seconds"] > 0 and "HashAggregate" in found["cells"]["plan"] and profile.resources(spark)["slots"] >= 1
    new = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "row_id bigint, chan int, corr int")
    assert write_flags(spark, str(tmp_path), new, ordered=True) == 20
    files = sorted(f for f in os.listdir(f"{tmp_path}/main.parquet") if f.endswith(".parquet"))
    ids = [[r.row_id for r in spark.read.parquet(f"{tmp_path}/main.parquet/{f}").collect()] for f in files]
    assert [i for part in ids for i in part] == list(range(40))
