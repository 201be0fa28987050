"""Bounded training samples: distinct texts per label, drawn by hash.

Every distinct text of a label is equally likely, however many copies it has, and no
label lacks a share.  The draw depends on the texts alone, so the same rows in other
partitions or another order give the same sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

_SPAN = 1 << 30


def text_hash(text: str = "text"):
    return F.xxhash64(F.col(text))


def draw(labelled: DataFrame, texts: DataFrame, rows: int, least: int, name: str) -> tuple[DataFrame, dict]:
    """(label, h, text), a stored table, and the number of rows of each label that
    ``labelled`` has.

    ``labelled`` is (label, h) with the hash of each labelled text, repeats included;
    ``texts`` is (text).  Each label gets its ``rows`` / labels texts of least hash, but
    ``least`` at any rate, or all it has.  A threshold from an estimate of the number
    of distinct texts keeps the ordered step to about twice what is drawn.
    """
    sizes = materialize(labelled.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")), f"{name}-sizes")
    counts = {r["label"]: r["n"] for r in sizes.select("label", "n").collect()}
    each = max(least, rows // max(1, len(counts)))
    near = labelled.join(sizes.select("label", "d"), "label")
    near = near.filter(F.pmod("h", F.lit(_SPAN)) < (2.0 * each + 40) / F.col("d") * _SPAN).select("label", "h").distinct()
    order = Window.partitionBy("label").orderBy(F.pmod("h", F.lit(_SPAN)), "h")
    chosen = materialize(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select("label", "h"), f"{name}-chosen")
    # At most ``each`` rows of two columns for each label.
    found = texts.filter("text is not null").withColumn("h", text_hash()).join(F.broadcast(chosen), "h")
    sample = materialize(found.groupBy("label", "h").agg(F.min("text").alias("text")), f"{name}-sample")
    drop_scratch(sizes, chosen)
    return sample, counts
