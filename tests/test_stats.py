import numpy as np
import pytest

from fringeworks.operators import stats
from fringeworks.schema import CELL

SCHEMA = "spw_id int, corr int, cell_u int, cell_v int, value float"


def frame(spark, *groups):
    return spark.createDataFrame([(0, 0, u, v, float(x)) for (u, v), xs in groups for x in xs], SCHEMA)


def table(df):
    return {(r.cell_u, r.cell_v): (r.n, r.median, r.std) for r in df.collect()}


@pytest.mark.parametrize("method", ["exact", "hybrid"])
def test_literals(spark, method):
    df = frame(spark, ((1, 0), range(1, 6)), ((0, 0), [10, 10, 10]), ((1, 1), [100, 200]), ((2, 0), [10, 20]), ((2, 1), [1] * 10 + [1000]), ((3, 0), [-5, 0, 5]), ((4, 0), [7.5]))
    got = table(stats.cell_stats(df, method))
    assert got[1, 0] == (5, 3, pytest.approx(1.4826)) and got[0, 0] == (3, 10, 0) and got[1, 1][1] == 150
    assert got[2, 0][2] == pytest.approx(7.413) and got[2, 1] == (11, 1, 0) and got[3, 0][2] == pytest.approx(7.413) and got[4, 0] == (1, 7.5, 0)


def test_invariants(spark):
    rng = np.random.default_rng(42)
    df = spark.createDataFrame([(0, 0, int(u), int(v), float(x)) for u, v, x in zip(rng.integers(0, 51, 3000), rng.integers(0, 26, 3000), rng.exponential(1, 3000), strict=True)], SCHEMA)
    got = table(stats.exact_stats(df))
    assert sum(n for n, _, _ in got.values()) == 3000 and all(s >= 0 for _, _, s in got.values())


@pytest.mark.parametrize("draw", [lambda r: r.normal(10, 2, 500), lambda r: r.uniform(0, 100, 1000), lambda r: np.concatenate([r.uniform(2, 4, 100), r.uniform(0, 8, 100)])])
def test_histogram_near_exact(spark, draw):
    df = frame(spark, ((0, 0), draw(np.random.default_rng(7))))
    (n, median, std), (n2, exact, mad) = table(stats.hybrid_stats(df))[0, 0], table(stats.exact_stats(df))[0, 0]
    assert n == n2 and median == pytest.approx(exact, rel=0.05) and std == pytest.approx(mad, rel=0.35)


def test_large_constant_cell(spark):
    n, median, std = table(stats.hybrid_stats(frame(spark, ((0, 0), [42.0] * 42))))[0, 0]
    assert n == 42 and median == 42.001953125 and std == pytest.approx(0.0014478317)


def test_both_sides_of_the_split(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, ((0, 0), rng.normal(5, 1, 32)), ((1, 0), rng.normal(5, 1, 33)))
    hybrid, exact = table(stats.hybrid_stats(df)), table(stats.exact_stats(df))
    assert hybrid[0, 0] == exact[0, 0] and hybrid[1, 0] != exact[1, 0]


def test_empty_and_nan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert stats.hybrid_stats(empty).count() == 0 == stats.exact_stats(empty).count()
    got = table(stats.hybrid_stats(frame(spark, ((0, 0), [float("nan"), 1, 2, 3]))))
    assert got[0, 0][:2] == (3, 2)


def test_counts_and_offsets(spark):
    df = frame(spark, ((0, 0), [1, 5]), ((1, 1), [3]), ((0, 1), [9]))
    ranges = {(r.cell_u, r.cell_v): (r.n, r.vmin, r.vmax) for r in stats.count_min_max(df).collect()}
    assert ranges[0, 0] == (2, 1, 5) and ranges[1, 1] == (1, 3, 3)
    first = {(r.cell_u, r.cell_v): r["first"] for r in stats.cell_offsets(stats.cell_counts(df)).collect()}
    assert first == {(0, 0): 0, (0, 1): 2, (1, 1): 3}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        stats.cell_stats(frame(spark, ((0, 0), [1])), "fast")


def test_plan_has_no_python(spark, capsys):
    stats.hybrid_stats(frame(spark, ((0, 0), [1]))).explain()
    assert "Python" not in capsys.readouterr().out
    assert CELL == ["spw_id", "corr", "cell_u", "cell_v"]
