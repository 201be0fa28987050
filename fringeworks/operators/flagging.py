"""Outlier decisions, and merging them into the source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeworks.schema import CELL, PAIR


def is_outlier() -> Column:
    """Above its cell's threshold, or in a cell without one.  A NaN value is no
    outlier of a cell that has a threshold."""
    no_threshold = F.col("threshold").isNull() | F.isnan("threshold")
    value = F.col("value")
    return no_threshold | F.coalesce(~F.isnan(value) & (value > F.col("threshold")), F.lit(False))


#: Thresholds of so many cells at most (about 100 MB as a hash table) go to all tasks.
BROADCAST_CELLS = 1_000_000


def lookup(thresholds: DataFrame, cells: int | None = None) -> DataFrame:
    """The columns that samples are joined with; marked for broadcast where the number
    of cells is known and small.  Otherwise Spark chooses by size."""
    kept = thresholds.select(*CELL, "threshold")
    return F.broadcast(kept) if cells is not None and cells <= BROADCAST_CELLS else kept


def judged(samples: DataFrame, thresholds: DataFrame, cells: int | None = None) -> DataFrame:
    """``samples`` with threshold and outlier."""
    return samples.join(lookup(thresholds, cells), CELL, "left").withColumn("outlier", is_outlier())


def flags(samples: DataFrame, thresholds: DataFrame, cells: int | None = None) -> DataFrame:
    return judged(samples, thresholds, cells).filter("outlier").select(*PAIR, "row_id", "chan")


def inliers(samples: DataFrame, thresholds: DataFrame, cells: int | None = None) -> DataFrame:
    """What remains for statistics after flagging: at most the threshold, which exists."""
    kept = F.col("threshold").isNotNull() & ~F.isnan("threshold") & ~F.isnan("value") & (F.col("value") <= F.col("threshold"))
    return samples.join(lookup(thresholds, cells), CELL).filter(kept).drop("threshold")


def summary(judged_samples: DataFrame) -> DataFrame:
    counts = judged_samples.groupBy(*PAIR).agg(F.count("*").alias("n_total"), F.count_if("outlier").alias("n_flagged"))
    return counts.withColumn("pct_flagged", F.round(F.col("n_flagged") * 100.0 / F.col("n_total"), 6))


def rollup_summary(judged_samples: DataFrame) -> DataFrame:
    return judged_samples.rollup(*PAIR).agg(F.count("*").alias("n_total"), F.count_if("outlier").alias("n_flagged"))


def _masks(new: DataFrame) -> DataFrame:
    """(row_id, _any, _keys): 64-bit words with a bit per channel, of all correlations
    together and of each.  One shuffle, by row; a row holds at most its channels times
    correlations."""
    none, corr = F.lit(0).cast("bigint"), F.col("corr").cast("int").alias("corr")
    bits = new.repartition("row_id").groupBy("row_id", corr, F.shiftright(F.col("chan").cast("int"), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(chan as int) & 63)")).alias("bits"))
    held = bits.groupBy("row_id").agg(F.collect_list(F.struct("corr", "word", "bits")).alias("held"), F.max("corr").alias("last"), F.max("word").alias("top"))
    total = lambda keep: F.aggregate(F.filter("held", keep), none, lambda s, h: s.bitwiseOR(h["bits"]))
    words = lambda keep: F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: total(lambda h: (h["word"] == w) & keep(h)))
    each = F.transform(F.sequence(F.lit(0), F.col("last")), lambda p: words(lambda h: h["corr"] == p))
    return held.select("row_id", words(lambda h: F.lit(True)).alias("_any"), each.alias("_keys"))


def _bit(words: Column, c: Column) -> Column:
    return F.coalesce(F.getbit(F.get(words, F.shiftright(c, 6)), F.pmod(c, F.lit(64))) == 1, F.lit(False))


def merge_flags(main: DataFrame, new: DataFrame) -> DataFrame:
    """``main`` with flags set where ``new`` (row_id, chan, corr) says so; no flag is
    ever cleared.  Adds n_new, the flags set in the row that were not before.

    Each channel is looked up by index in the row's bits; only channels with a new flag are
    looked into.
    """
    both = main.join(_masks(new), "row_id", "left")
    touched = lambda c: _bit(F.col("_any"), c)
    merged = F.transform("flag", lambda row, c: F.when(touched(c), F.transform(row, lambda f, p: f | _bit(F.get("_keys", p), c))).otherwise(row))
    ones = lambda cube: F.aggregate(F.filter(cube, lambda row, c: touched(c)), F.lit(0), lambda s, row: s + F.size(F.filter(row, lambda f: f)))
    old, untouched = F.col("flag"), F.col("_any").isNull()
    out = both.withColumn("_new", F.when(untouched, old).otherwise(merged))
    out = out.withColumn("n_new", F.when(untouched, F.lit(0)).otherwise(ones(F.col("_new")) - ones(old)).cast("bigint"))
    return out.select(*[F.col("_new").alias("flag") if c == "flag" else F.col(f"`{c}`") for c in main.columns], "n_new")


def newly_flagged(merged: DataFrame) -> DataFrame:
    return merged.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("newly_flagged"))
