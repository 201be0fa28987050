"""The instrument's tables through a stand-in library, and chunked scans and writes."""

import os

import numpy as np
import pytest

from fringeworks import FlagConfig, FlagRun
from fringeworks.plans.flagging_run import write_flags
from fringeworks.sources import tables, visibilities

OPENER = "tests.plain_tables:table"


@pytest.fixture
def stored(tmp_path):
    rng = np.random.default_rng(8)
    n, channels, correlations = 50, 6, 2
    data = (rng.normal(1, 0.05, (n, channels, correlations)) + 0.01j).astype(np.complex64)
    data[7, 3, 1] = 90
    columns = {
        "": {"TIME": np.arange(n) // 5 * 1.0, "DATA_DESC_ID": np.arange(n) % 2, "FIELD_ID": np.zeros(n, int), "UVW": rng.uniform(-30, 30, (n, 3)), "DATA": data, "FLAG": rng.random((n, channels, correlations)) < 0.1, "MODEL_DATA": np.zeros_like(data)},
        "SPECTRAL_WINDOW": {"CHAN_FREQ": 1e9 + 1e6 * np.arange(2 * channels).reshape(2, channels), "REF_FREQUENCY": np.array([1e9, 1.006e9])},
        "POLARIZATION": {"NUM_CORR": np.array([correlations])},
        "ANTENNA": {"POSITION": np.array([[0.0, 0, 0], [30.0, 40.0, 0.0]])},
    }
    columns[""]["FLAG"][7, 3, 1] = False
    for name, held in columns.items():
        os.makedirs(tmp_path / "ms" / name, exist_ok=True)
        for c, v in held.items():
            np.save(tmp_path / "ms" / name / f"{c}.npy", v)
    return str(tmp_path / "ms"), columns[""]


def test_reading_and_writing(spark, stored):
    path, columns = stored
    data = tables.open_tables(spark, path, OPENER, rows=8)
    rows = data.main.orderBy("row_id").collect()
    assert data.main.rdd.getNumPartitions() == 7 and len(rows) == 50 and "model_data" in data.main.columns
    assert np.allclose([[[complex(z.re, z.im) for z in ch] for ch in r.data] for r in rows], columns["DATA"])
    assert (np.array([r.flag for r in rows]) == columns["FLAG"]).all() and np.allclose([r.uvw for r in rows], columns["UVW"])
    assert [(r.spw_id, r.n_chan, r.n_corr) for r in data.windows.collect()] == [(0, 6, 2), (1, 6, 2)] and visibilities.max_baseline(data.antennas).first()[0] == 50
    run = FlagRun(data, FlagConfig(cell_size=400.0, nsigma=8.0))
    n = tables.write_flag_column(run.merged, path, OPENER, rows=3)
    after = np.load(f"{path}/FLAG.npy")
    assert n == (after & ~columns["FLAG"]).sum() > 0 and (after >= columns["FLAG"]).all() and after[7, 3, 1]


def test_missing_library(spark, stored):
    with pytest.raises(ImportError, match="no_such_library"):
        tables.opener_of("no_such_library:table")


def test_chunks(spark, stored):
    data = tables.open_tables(spark, stored[0], OPENER, rows=20)
    parts = list(visibilities.iter_chunks(data, 16))
    assert [p.num_rows for p in parts] == [16, 16, 16, 2] and [r for p in parts for r in p.column("row_id").to_pylist()] == list(range(50))
    assert sum(p.num_rows for p in visibilities.iter_chunks(data, 16, spw_id=1)) == 25 and list(visibilities.iter_chunks(data, 16, spw_id=9)) == []


def test_write_flags(spark, tmp_path):
    """Flags are set where named, whatever value comes with them, and never cleared."""
    rows = [(i, [[False, True], [False, False]]) for i in range(4)]
    spark.createDataFrame(rows, "row_id bigint, flag array<array<boolean>>").write.parquet(f"{tmp_path}/main.parquet")
    new = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, False), (3, 1, 1, False), (9, 0, 0, True)], "row_id bigint, chan int, corr int, flag boolean")
    assert write_flags(spark, str(tmp_path), new) == 2 and write_flags(spark, str(tmp_path), new) == 0
    got = {r.row_id: r.flag for r in spark.read.parquet(f"{tmp_path}/main.parquet").collect()}
    assert got == {0: rows[0][1], 1: [[True, True], [False, False]], 2: rows[0][1], 3: [[False, True], [False, True]]}


def test_wide_rows(spark):
    """300 channels: bits beyond one word, and a whole row flagged."""
    from fringeworks.operators.flagging import merge_flags

    main = spark.createDataFrame([(i, [[False, False]] * 300) for i in range(3)], "row_id bigint, flag array<array<boolean>>")
    wanted = {(0, c, p) for c in (0, 63, 64, 127, 128, 299) for p in (0, 1) if (c + p) % 2} | {(1, c, p) for c in range(300) for p in (0, 1)}
    out = {r.row_id: r for r in merge_flags(main, spark.createDataFrame(sorted(wanted), "row_id bigint, chan int, corr int")).collect()}
    assert {(i, c, p) for i, r in out.items() for c, row in enumerate(r.flag) for p, f in enumerate(row) if f} == wanted
    assert {i: r.n_new for i, r in out.items()} == {0: 6, 1: 600, 2: 0}
