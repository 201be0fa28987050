"""A folder of intermediate results: samples, cells, after-cells and flags as
Parquet partitioned by spw_id and corr, spectral windows, and meta.json.

Everything goes through Spark's file systems, so the folder may be in any store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from fringeworks.config import FlagConfig
from fringeworks.schema import PAIR


class ResultCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def create(self, source: str, config: FlagConfig, grid_shape: tuple[int, int], windows: DataFrame | None = None) -> ResultCache:
        meta = {"source": source, "cell_size": config.cell_size, "config_json": config.to_json(), "grid_shape": list(grid_shape)}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta.json")
        if windows is not None:
            windows.write.mode("overwrite").parquet(f"{self.path}/spectral_window")
        return self

    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/meta.json").first()[0])

    def config(self) -> FlagConfig:
        return FlagConfig.from_json(self.meta()["config_json"])

    def grid_shape(self) -> tuple[int, int]:
        return tuple(self.meta()["grid_shape"])

    def windows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/spectral_window")

    def store(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Write, one folder per window and correlation, and read back."""
        df.write.mode(mode).partitionBy(*PAIR).parquet(f"{self.path}/{name}")
        return self.load(name, df.schema)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").partitionBy(*PAIR).parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        fs, p = self._fs()
        return fs.exists(p.suffix(f"/{name}"))

    def load(self, name: str, schema=None, spw_id: int | None = None, corr: int | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        df = reader.parquet(f"{self.path}/{name}")
        for column, wanted in (("spw_id", spw_id), ("corr", corr)):
            if wanted is not None:
                df = df.filter(df[column] == wanted)
        return df

    def delete(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)

    def delete_quietly(self) -> None:
        """For the end of a process, where the session may be gone already."""
        try:
            self.delete()
        except Exception:  # noqa: BLE001
            pass


def open_readonly(spark: SparkSession, path: str) -> ResultCache:
    cache = ResultCache(spark, path)
    cache.meta()
    return cache


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """All rows of all shards; order does not matter."""
    if not shards:
        raise ValueError("no shard to merge")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out
