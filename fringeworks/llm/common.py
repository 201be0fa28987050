"""Shared plumbing: reading, shared scratch tables, Arrow batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay under this many rows and bytes, so a
#: worker's memory does not depend on how long the texts are (one text is the
#: least that a batch can hold).
BATCH_ROWS = 2000
BATCH_BYTES = "16MB"

_own_scratch: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``.  Where the
    session names none, a temporary folder serves a session of one process (tests);
    on a cluster that is an error, since executors would not see each other's files."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="fringeworks-")
        atexit.register(shutil.rmtree, _own_scratch, ignore_errors=True)
    return _own_scratch


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the reading tasks, never the
    plan above, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, condition=None) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows written, or of those that meet a
    condition, without another job."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    stored = materialize(df.observe(seen, F.count(F.lit(1) if condition is None else F.when(condition, 1)).alias("n")), label)
    return stored, int(seen.get["n"] or 0)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the scratch tables that these DataFrames read; only once nothing needs
    them.  Files outside the shared scratch folder are left alone."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).toUri().getPath()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            if path.toUri().getPath().startswith(f"{root}/"):
                path.getFileSystem(conf).delete(path, True)


def arrow_limits(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: A worker that has had no task for so long drops what it kept.
IDLE_SECONDS = 6.0
_state: dict = {}
_busy: list = []
#: Held where tasks begin and end and where an idle worker drops its state, so that
#: nothing is dropped under a running task.
_turn = threading.RLock()


def trim(collect: bool = True) -> None:
    """Give freed memory back to the machine."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_state(key: tuple, build: Callable):
    """What a worker keeps from task to task (a model, a cache): one thing at a time."""
    if key not in _state:
        _state.clear()
        _state[key] = build()
    return _state[key]


def _enter(key: tuple | None) -> None:
    """Workers are used again for other operators; what the last one kept is given
    back to the machine first."""
    with _turn:
        _busy.append(key)
        if _state and key not in _state:
            _state.clear()
            trim()


def _leave() -> None:
    with _turn:
        _busy.pop()
        trim(collect=False)
    idle = threading.Timer(IDLE_SECONDS, _rest)
    idle.daemon = True
    idle.start()


def _rest() -> None:
    with _turn:
        if _state and not _busy:
            _state.clear()
            trim()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it by PYTHONPATH or in the
    working directory, as the driver does."""
    root = Path(__file__).resolve().parents[2]
    paths = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if root in paths or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="fringeworks-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/fringeworks.zip", "w") as out:
        for f in sorted((root / "fringeworks").rglob("*.py")):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/fringeworks.zip")


_shipped: set[str] = set()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, state: tuple | None = None) -> DataFrame:
    """``fn`` over Arrow batches; ``state`` is the key of the worker state it uses."""
    arrow_limits(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(state)
        try:
            yield from fn(batches)
        finally:
            _leave()

    return df.mapInArrow(run, schema)


def in_one_task(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """``fn`` over all of ``df`` in one task of an executor, in the given order.  Only for
    tables of a size that a parameter bounds, such as training samples."""
    return map_batches(df.repartition(1).sortWithinPartitions(*order), fn, schema)


def pack_row(df: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """``row``, a struct of the columns to keep by position, so that their names
    clash with nothing; the text is its field ``text``, once."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep) if c != text]
    return df.select(F.struct(*fields, F.col(f"`{text}`").alias("text")).alias("row"))


def unpack_row(df: DataFrame, keep: tuple[str, ...], text: str, *added: str) -> DataFrame:
    return df.select(*[F.col("row.text" if c == text else f"row.c{i}").alias(c) for i, c in enumerate(keep)], *added)


def row_texts(batch: pa.RecordBatch) -> list[str | None]:
    row = batch.column("row")
    return row.field(row.type.get_field_index("text")).to_pylist()


def text_column(df: DataFrame, text: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by name without regard to case, as Spark resolves them."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
