"""The instrument's own tables, read and written without a conversion first.

Reading is a Spark data source: the main table is cut into row ranges, one partition
each, and every executor opens the table for its range.  The library that opens tables is
named by an option (``module:function``, by default python-casacore's); where it cannot
be imported the error says so.  Flags are written by the driver alone, since a table has
one writer, in row order and in batches of bounded size.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fringeworks.schema import ANTENNAS, CUBE, SPECTRAL_WINDOWS, VISIBILITIES
from fringeworks.sources.visibilities import Dataset

FORMAT = "visibility_tables"
OPENER = "casacore.tables:table"
ROWS = 10_000
_CUBES = {"data": "DATA", "model_data": "MODEL_DATA", "corrected_data": "CORRECTED_DATA"}


def opener_of(name: str) -> Callable:
    """The function that opens a table: ``f(path)`` with nrows, colnames, getcol, putcol
    and close."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except ImportError as e:
        raise ImportError(f"reading tables needs {module}, which cannot be imported here; install it on the driver and all executors, name another opener, or convert the tables to Parquet") from e


@dataclass
class RowRange(InputPartition):
    start: int
    count: int

    def __init__(self, start: int, count: int):
        super().__init__((start, count))
        self.start, self.count = start, count


def _nested(values: pa.Array, shape: tuple[int, ...]) -> pa.Array:
    """Rows of ``shape[1]`` lists of ``shape[2]`` of the flat values."""
    rows, channels, correlations = shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(rows * channels + 1) * correlations, pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * channels, pa.int32()), inner)


def _cube(z: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(z, dtype=np.complex64).reshape(-1)
    return _nested(pa.StructArray.from_arrays([pa.array(flat.real.copy()), pa.array(flat.imag.copy())], ["re", "im"]), z.shape)


class MainReader(DataSourceReader):
    def __init__(self, path: str, opener: str, rows: int, columns: list[str]):
        self.path, self.opener, self.rows, self.columns = path, opener, rows, columns

    def partitions(self) -> list[InputPartition]:
        table = opener_of(self.opener)(self.path)
        n = table.nrows()
        table.close()
        return [RowRange(at, min(self.rows, n - at)) for at in range(0, n, self.rows)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        table = opener_of(self.opener)(self.path)
        try:
            get = lambda name: np.asarray(table.getcol(name, partition.start, partition.count))
            made = {
                "row_id": lambda: pa.array(np.arange(partition.start, partition.start + partition.count)),
                "time": lambda: pa.array(get("TIME").astype(np.float64)),
                "spw_id": lambda: pa.array(get("DATA_DESC_ID").astype(np.int32)),
                "field_id": lambda: pa.array(get("FIELD_ID").astype(np.int32)),
                "uvw": lambda: pa.array(list(get("UVW").astype(np.float64)), pa.list_(pa.float64())),
                "flag": lambda: _nested(pa.array(get("FLAG").astype(bool).reshape(-1)), get("FLAG").shape),
            }
            arrays = [_cube(get(_CUBES[c])) if c in _CUBES else made[c]() for c in self.columns]
            yield pa.RecordBatch.from_arrays(arrays, self.columns)
        finally:
            table.close()


class MainTable(DataSource):
    """Options: path, opener, rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _opener(self) -> str:
        return self.options.get("opener", OPENER)

    def schema(self) -> str:
        table = opener_of(self._opener())(self.options["path"])
        has = set(table.colnames())
        table.close()
        return VISIBILITIES + "".join(f", {c} {CUBE}" for c in ("model_data", "corrected_data") if _CUBES[c] in has)

    def reader(self, schema) -> DataSourceReader:
        return MainReader(self.options["path"], self._opener(), int(self.options.get("rows", ROWS)), [f.name for f in schema.fields])


def open_tables(spark: SparkSession, path: str, opener: str = OPENER, rows: int = ROWS) -> Dataset:
    """The data set in ``path``; the windows and antennas, a few hundred rows of the
    receiver's own, are read by the driver."""
    spark.dataSource.register(MainTable)
    main = spark.read.format(FORMAT).option("opener", opener).option("rows", rows).load(path)
    get = opener_of(opener)

    def columns(name: str, *wanted: str) -> list[np.ndarray]:
        table = get(f"{path}::{name}")
        try:
            return [np.asarray(table.getcol(c)) for c in wanted]
        finally:
            table.close()

    freqs, refs = columns("SPECTRAL_WINDOW", "CHAN_FREQ", "REF_FREQUENCY")
    (n_corr,) = columns("POLARIZATION", "NUM_CORR")
    (places,) = columns("ANTENNA", "POSITION")
    windows = [(i, [float(x) for x in f], float(r), len(f), int(n_corr[0])) for i, (f, r) in enumerate(zip(freqs, refs, strict=True))]
    antennas = [(i, *map(float, p)) for i, p in enumerate(places)]
    return Dataset(main, spark.createDataFrame(windows, SPECTRAL_WINDOWS), spark.createDataFrame(antennas, ANTENNAS), path)


def write_flag_column(merged: DataFrame, path: str, opener: str = OPENER, rows: int = ROWS) -> int:
    """Set the flags of ``merged`` (row_id, flag, n_new) in the table, rows with new flags
    only, in row order; the number of flags set."""
    changed = merged.filter("n_new > 0").select("row_id", "flag", "n_new").orderBy("row_id")
    table, total = opener_of(opener)(path, readonly=False), 0

    def put(batch: list) -> int:
        """Runs of neighbouring rows are one write each."""
        ids = np.array([r["row_id"] for r in batch])
        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):
            table.putcol("FLAG", np.array([batch[i]["flag"] for i in part], dtype=bool), int(ids[part[0]]), len(part))
        return sum(r["n_new"] for r in batch)

    try:
        batch: list = []
        for row in changed.toLocalIterator():
            batch.append(row)
            if len(batch) == rows:
                total += put(batch)
                batch = []
        total += put(batch) if batch else 0
    finally:
        table.close()
    return total
