import math

import pytest
from pyspark.sql import functions as F

from fringeworks.functions import coords
from fringeworks.functions.quantity import check_quantity, conjugate, quantity_of, subtract_cubes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scaling(spark):
    r = one(spark, coords.in_wavelengths(F.lit(100.0), F.lit(1e9)).alias("a"), coords.in_wavelengths(F.lit(100.0), F.lit(2e9)).alias("b"))
    assert r.a == pytest.approx(100e9 / 299792458, rel=1e-15) and r.b == 2 * r.a


def test_fold(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (-2.0, -1.0), (3.0, 0.0), (-3.0, 0.0)], "u double, v double")
    got = [tuple(r) for r in rows.select(coords.fold(F.col("v"), F.col("u")), coords.fold(F.col("v"), F.col("v"))).collect()]
    assert got == [(1, 1), (2, 1), (3, 0), (-3, 0)]


@pytest.mark.parametrize(("us", "vs", "want"), [((25.0, -10.0), (0.0, 15.0), 3), ((-50.0, -30.0), (0.0, 0.0), 5), ((11.0, 0.0), (0.0, 0.0), 2), ((0.0, 0.0), (0.0, 0.0), 0)])
def test_half_size(spark, us, vs, want):
    rows = spark.createDataFrame(list(zip(us, vs, strict=True)), "u double, v double")
    assert rows.agg(coords.half_size_of(F.col("u"), F.col("v"), 10.0)).first()[0] == want
    assert coords.half_size(max(map(abs, us + vs)), 10.0) == want


@pytest.mark.parametrize(("u", "v", "want"), [(25.0, 15.0, (102, 2)), (-15.0, 5.0, (98, 0)), (5.0, 5.0, (100, 0)), (0.0, 0.0, (100, 0)), (35.0, 45.0, (104, 4))])
def test_half_to_even_cells(spark, u, v, want):
    assert tuple(one(spark, coords.cell_u(F.lit(u), 10.0, 100), coords.cell_v(F.lit(v), 10.0))) == want


def test_shape_and_flat_index(spark):
    assert coords.grid_shape(5) == (11, 6)
    assert one(spark, coords.flat_cell(F.lit(2), F.lit(3), 5))[0] == 15


def test_rings(spark):
    radii = spark.createDataFrame([(0.0,), (4.99,), (5.0,), (105.0,), (1e9,)], "r double")
    assert [r[0] for r in radii.select(coords.ring_index(F.col("r"), (5.0, 100.0))).collect()] == [0, 0, 1, 2, 2]


def test_uvrange_includes_both_ends(spark):
    rows = spark.createDataFrame([(3.0, 4.0), (6.0, 8.0), (6.1, 8.0), (0.0, 4.9)], "u double, v double")
    assert [r[0] for r in rows.select(coords.within_uvrange(F.col("u"), F.col("v"), (5, 10))).collect()] == [True, True, False, False]


def test_quantities(spark):
    of = lambda re, im, q: one(spark, quantity_of(F.lit(re), F.lit(im), q))[0]
    assert of(3.0, 4.0, "amplitude") == 5 and of(-1.0, 0.0, "amplitude") == 1
    assert [of(a, b, "phase") for a, b in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0))] == pytest.approx([0, math.pi / 2, math.pi], rel=1e-6)
    assert (of(3.0, 4.0, "real"), of(3.0, 4.0, "imag"), of(0.0, 0.0, "amplitude")) == (3, 4, 0)
    assert spark.range(1).select(quantity_of(F.lit(1.0), F.lit(1.0), "phase").alias("x")).schema["x"].dataType.simpleString() == "float"
    with pytest.raises(ValueError, match="Unknown quantity"):
        check_quantity("power")


def test_complex_arithmetic(spark):
    df = spark.sql("select array(array(struct(float(3) as re, float(2) as im))) as a, array(array(struct(float(1) as re, float(5) as im))) as b")
    z = df.select(subtract_cubes(F.col("a"), F.col("b")).alias("d"), conjugate(F.col("a")[0][0]).alias("c")).first()
    assert tuple(z.d[0][0]) == (2, -3) and tuple(z.c) == (3, -2)
