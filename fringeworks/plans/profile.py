"""What a run has to work with, and where its time goes."""

from __future__ import annotations

import io
import time
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession

from fringeworks.plans.flagging_run import FlagRun

STEPS = ("samples", "cells", "thresholds", "flags", "summary", "cells_after", "merged")


def resources(spark: SparkSession) -> dict[str, str | int]:
    """Task slots, and the memory of the driver and of an executor as configured."""
    conf = spark.sparkContext.getConf()
    return {"slots": spark.sparkContext.defaultParallelism, "driver_memory": conf.get("spark.driver.memory", "1g"), "executor_memory": conf.get("spark.executor.memory", "1g")}


def plan_of(df: DataFrame) -> str:
    """The formatted physical plan."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def profile(run: FlagRun, steps: tuple[str, ...] = STEPS) -> dict[str, dict]:
    """Seconds and plan of each step of a run, computed one after the other.  With a cache
    a step's time is its own; without, it includes the steps before."""
    found = {}
    for name in steps:
        at = time.perf_counter()
        df = getattr(run, name)
        df.write.format("noop").mode("overwrite").save()
        found[name] = {"seconds": time.perf_counter() - at, "plan": plan_of(df)}
    return found
