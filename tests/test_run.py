import json
import os

import numpy as np
import pytest

from fringeworks import FlagConfig, FlagRun, flag_visibilities
from fringeworks.cli import main as cli
from fringeworks.cli import parser
from fringeworks.logs import setup_logging
from fringeworks.operators.gridexport import dense_grid, extent_in_kilolambda, norm_of, scale_range
from fringeworks.plans.plots import plot_from_cache
from fringeworks.schema import VISIBILITIES
from fringeworks.sources import cache, visibilities
from fringeworks.streaming import incremental


@pytest.fixture
def source(spark, tmp_path):
    """60 x 8 x 2 samples near amplitude 1, with strong ones planted."""
    rng = np.random.default_rng(3)
    planted, rows = set(), []
    for i in range(60):
        data = [[(float(x), float(y)) for x, y in rng.normal((1, 0), 0.05, (2, 2))] for _ in range(8)]
        if i % 10 == 0:
            data[i % 8][0] = (40.0, 9.0)
            planted.add((i, i % 8, 0))
        flag = [[c == 7, False] for c in range(8)]
        rows.append((i, float(i // 6), 0, i % 2, [float(rng.uniform(-30, 30)), float(rng.uniform(-30, 30)), 0.0], data, flag))
    path = str(tmp_path / "set")
    spark.createDataFrame(rows, VISIBILITIES).write.parquet(f"{path}/main.parquet")
    spark.createDataFrame([(0, [1e9 + c * 1e6 for c in range(8)], 1e9, 8, 2)], "spw_id int, chan_freqs array<double>, ref_freq double, n_chan int, n_corr int").write.parquet(f"{path}/spectral_window.parquet")
    spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 30.0, 40.0, 0.0)], "antenna_id int, x double, y double, z double").write.parquet(f"{path}/antenna.parquet")
    return path, planted


def flagged(spark, path):
    return {(r.row_id, c, p) for r in spark.read.parquet(f"{path}/main.parquet").collect() for c, row in enumerate(r.flag) for p, f in enumerate(row) if f}


def test_end_to_end(spark, source, tmp_path):
    path, planted = source
    before = flagged(spark, path)
    planted = {p for p in planted if p not in before}
    result = flag_visibilities(spark, path, cell_size=200.0, nsigma=8.0, cache_path=str(tmp_path / "cache"), plot_dir=str(tmp_path / "plots"))
    after = flagged(spark, path)
    assert before <= after and planted <= after and len(after - before) == result["total_newly_flagged"]
    assert len(after - before - planted) <= 12
    assert "n_new" not in spark.read.parquet(f"{path}/main.parquet").columns and sorted(os.listdir(path)) == ["antenna.parquet", "main.parquet", "spectral_window.parquet"]
    assert len(result["plots"]) == 4 and all(os.path.exists(p) for p in result["plots"])
    kept = cache.open_readonly(spark, result["cache_path"])
    assert kept.grid_shape() == result["grid_shape"] and kept.config().nsigma == 8.0 and kept.windows().count() == 1
    assert kept.load("samples", spw_id=0, corr=1).select("corr").distinct().first()[0] == 1
    assert len(plot_from_cache(spark, result["cache_path"], str(tmp_path / "again"))) == 4
    again = flag_visibilities(spark, path, cell_size=200.0, nsigma=1e6)
    assert again["total_newly_flagged"] == 0 and again["cache_path"] is None and flagged(spark, path) == after
    assert sorted(os.listdir(tmp_path)) == ["again", "cache", "plots", "set"]


def test_selection(spark, source):
    path, _ = source
    data = visibilities.open_dataset(spark, path)
    run = FlagRun(data, FlagConfig(cell_size=200.0, field_ids=(1,), uvrange=(0.0, 5000.0)))
    assert {r[0] % 2 for r in run.samples.select("row_id").distinct().collect()} == {1} and run.n == 25
    assert visibilities.row_count(data) == 60 and visibilities.scan(data, 5).count() == 0
    with pytest.raises(ValueError, match="spectral window"):
        _ = FlagRun(data, FlagConfig(spw_ids=(9,))).n
    with pytest.raises(ValueError, match="quantity"):
        FlagRun(data, FlagConfig(quantity="power"))


def test_column_resolution(spark):
    cube = "array<array<struct<re: float, im: float>>>"
    base = spark.createDataFrame([(i, [[(1.0, 0.0)]], [[(0.0, 0.5 if i == 3 else 0.0)]], [[(2.0, 0.0)]]) for i in range(5)], f"row_id bigint, data {cube}, model_data {cube}, corrected_data {cube}")
    resolve = visibilities.resolve_column
    assert resolve(base) == "data-model" and resolve(base.drop("data")) == "corrected_data-model"
    assert resolve(base.filter("row_id < 3")) == "data" and resolve(base.withColumn("residual", base.data)) == "residual" and resolve(base, "CORRECTED_DATA") == "CORRECTED_DATA"
    z = visibilities.with_values(base, "corrected_data-model").orderBy("row_id").collect()[3].z[0][0]
    assert tuple(z) == (2, -0.5)


def test_row_chunks(spark):
    main = spark.createDataFrame([(i, float(i // 4)) for i in range(42)], "row_id bigint, time double")
    chunks = [(r.start_row, r.n_rows) for r in visibilities.row_chunks(main, 3).orderBy("chunk").collect()]
    assert chunks == [(0, 12), (12, 12), (24, 18)]
    assert visibilities.row_chunks(main, 100).count() == 11


def test_config(tmp_path):
    c = FlagConfig(20.0, 5.0, annulus_widths=(1000.0, 2000.0), spw_ids=(0, 2), field_ids=(1,), uvrange=(100.0, 50000.0))
    assert FlagConfig.from_json(c.to_json()) == c and FlagConfig.from_json(FlagConfig().to_json()) == FlagConfig()
    assert FlagConfig().annulus_widths == (3000.0, 3000.0, 6500.0) and json.loads(c.to_json())["n_bins"] == 256
    with pytest.raises(AttributeError):
        c.nsigma = 1


def test_cli_rules(capsys):
    a = parser().parse_args(["x", "--uvrange", "100,500", "--spw", "1", "--spw", "2", "--quantity", "real"])
    assert a.uvrange == (100.0, 500.0) and a.spw_ids == [1, 2]
    for bad in ([], ["--plot-cached", "/nowhere"], ["x", "--uvrange", "1"], ["x", "--quantity", "power"]):
        with pytest.raises(SystemExit):
            cli(bad)
    capsys.readouterr()


def test_cli_run(spark, source, capsys):
    assert cli([source[0], "--cell-size", "200", "--nsigma", "8"]) == 0
    assert "Flagged" in capsys.readouterr().out


def test_logging():
    log = setup_logging("debug")
    assert log.level == 10 and setup_logging("nonsense").level == 20 and len(setup_logging("WARNING").handlers) == 1


CELLS = "spw_id int, corr int, cell_u int, cell_v int, n bigint, median float, std float"


def test_grid_export(spark):
    cells = spark.createDataFrame([(0, 0, 1, 1, 4, 2.5, 0.5)], CELLS)
    rows = {(r.cell_u, r.cell_v): (r.n, r.median) for r in dense_grid(cells, 2).collect()}
    assert len(rows) == 15 and rows[1, 1] == (4, 2.5) and rows[0, 0] == (0, 0)
    other = spark.createDataFrame([(0, 0, 1, 1, 4, -1.0, 0.0), (0, 0, 2, 1, 4, float("nan"), 0.0), (0, 0, 2, 2, 4, 0.0, 0.0)], CELLS)
    assert tuple(scale_range(cells, other).first()) == (-1, 2.5)
    assert norm_of(1, 5)["kind"] == "log" and norm_of(-1, 5)["linthresh"] == 5e-3 and norm_of(0, 0)["linthresh"] == 1
    assert extent_in_kilolambda(3, 1000.0) == (-3, 3, 0, 3)


def test_cache(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1, 1, 4, 2.5, 0.5), (1, 1, 1, 1, 4, 2.5, 0.5)], CELLS)
    c = cache.ResultCache(spark, str(tmp_path / "c")).create("set", FlagConfig(), (11, 6))
    assert c.store("cells", cells).count() == 2 and c.store("cells", cells).count() == 2
    c.append("cells", cells)
    assert c.load("cells", spw_id=1).count() == 2 and c.has("cells") and not c.has("flags") and c.meta()["cell_size"] == 10.0
    assert cache.merge_shards([cells, cells, cells.limit(0)]).count() == 4
    with pytest.raises(ValueError):
        cache.merge_shards([])
    c.delete()
    assert not os.path.exists(c.path)


def test_stream_appends_once(spark, tmp_path):
    schema = "spw_id int, corr int, cell_u int, cell_v int, value float"
    spark.createDataFrame([(0, 0, 1, 1, 2.0), (0, 0, 1, 1, 5.0)], schema).write.parquet(str(tmp_path / "in"))
    c = cache.ResultCache(spark, str(tmp_path / "c"))
    for _ in range(2):
        incremental.append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "ck")).awaitTermination()
    parts = spark.read.parquet(f"{c.path}/counts_stream").drop("batch")
    r = incremental.merge_counts(parts).first()
    assert (r.n, r.vmin, r.vmax) == (2, 2, 5)
