"""Column expressions on complex structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fringeworks.config import QUANTITIES


def check_quantity(quantity: str) -> str:
    if quantity not in QUANTITIES:
        raise ValueError(f"Unknown quantity: {quantity!r} (one of {', '.join(QUANTITIES)})")
    return quantity


def quantity_of(re: Column, im: Column, quantity: str) -> Column:
    """A float from the parts of a complex number, in double arithmetic."""
    check_quantity(quantity)
    re, im = re.cast("double"), im.cast("double")
    if quantity == "amplitude":
        out = F.hypot(re, im)
    elif quantity == "phase":
        out = F.atan2(im, re)
    else:
        out = re if quantity == "real" else im
    return out.cast("float")


def subtract(a: Column, b: Column) -> Column:
    return F.struct((a["re"] - b["re"]).alias("re"), (a["im"] - b["im"]).alias("im"))


def subtract_cubes(a: Column, b: Column) -> Column:
    """Element-wise difference of [channel][correlation] arrays."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, subtract))


def conjugate(z: Column) -> Column:
    return F.struct(z["re"].alias("re"), (-z["im"]).alias("im"))
