import math

import pytest

from fringeworks.operators import flagging, thresholds

CELLS = "spw_id int, corr int, cell_u int, cell_v int, n bigint, median float, std float"


def grid(spark, nu, nv, fn=lambda u, v: (1, 5.0, 1.0)):
    return spark.createDataFrame([(0, 0, u, v, *fn(u, v)) for u in range(nu) for v in range(nv) if fn(u, v)], CELLS)


def by_cell(df, column):
    return {(r.cell_u, r.cell_v): r[column] for r in df.collect()}


def brute(cells, kernel, k):
    """Count-weighted mean over the box of each cell."""
    back, ahead, out = kernel // 2, kernel - kernel // 2 - 1, {}
    rows = {(r.cell_u, r.cell_v): r for r in cells.collect()}
    for u, v in rows:
        box = [r for (a, b), r in rows.items() if u - back <= a <= u + ahead and v - back <= b <= v + ahead]
        n = sum(r.n for r in box)
        out[u, v] = (sum(r.median * r.n for r in box) / n + k * sum(r.std * r.n for r in box) / n, len(box) - 1)
    return out


def test_uniform_grid(spark):
    local = by_cell(thresholds.neighbourhood(grid(spark, 11, 6, lambda u, v: (100, 5.0, 1.0)), 3, 3.0), "local_thr")
    assert local[5, 3] == 8 and set(local.values()) == {8}


def test_kernel_of_one(spark):
    cells = grid(spark, 3, 3, lambda u, v: (1, 1.0 + 3 * u + v, 1.0))
    assert by_cell(thresholds.neighbourhood(cells, 1, 1.0), "local_thr") == {(u, v): 2.0 + 3 * u + v for u in range(3) for v in range(3)}


@pytest.mark.parametrize("kernel", [1, 2, 3, 4, 5])
def test_against_brute_force(spark, kernel):
    cells = grid(spark, 7, 5, lambda u, v: None if (u * 5 + v) % 4 == 1 else (1 + (u * v) % 5, float(u + 2 * v), 0.5 * u))
    got = {(r.cell_u, r.cell_v): (r.local_thr, r.n_neighbors) for r in thresholds.neighbourhood(cells, kernel, 3.0).collect()}
    want = brute(cells, kernel, 3.0)
    assert got.keys() == want.keys()
    for c in got:
        assert got[c][0] == pytest.approx(want[c][0], rel=1e-6) and got[c][1] == want[c][1]


@pytest.mark.parametrize(("shape", "kernel", "cell", "want"), [((7, 4), 3, (3, 2), 8), ((5, 5), 3, (0, 0), 3), ((9, 9), 5, (4, 4), 24), ((1, 1), 5, (0, 0), 0)])
def test_neighbours(spark, shape, kernel, cell, want):
    assert by_cell(thresholds.neighbourhood(grid(spark, *shape), kernel, 3.0), "n_neighbors")[cell] == want


def test_one_ring(spark):
    cells = thresholds.rings(grid(spark, 11, 6, lambda u, v: (1, 10.0, 2.0)), 10.0, (1e6,), 5)
    assert set(by_cell(thresholds.annular(cells, 3.0), "annular_thr").values()) == {16}


def test_two_rings(spark):
    cells = grid(spark, 21, 11, lambda u, v: (1, 100.0, 10.0) if (u, v) == (10, 0) else (1, 1.0, 0.1) if (u, v) == (10, 10) else None)
    got = by_cell(thresholds.annular(thresholds.rings(cells, 1.0, (5.0, 100.0), 10), 3.0), "annular_thr")
    assert got[10, 0] == 130 and got[10, 10] == pytest.approx(1.3)


@pytest.mark.parametrize(("local", "annular", "near", "least", "want"), [(10.0, 8.0, 5, 3, 8), (10.0, 12.0, 0, 3, 12), (5.0, 8.0, 0, 0, 5), (math.nan, 7.0, 5, 3, 7), (8.0, 12.0, 5, 3, 8)])
def test_combine(spark, local, annular, near, least, want):
    df = spark.createDataFrame([(local, annular, near)], "local_thr float, annular_thr float, n_neighbors int")
    assert thresholds.combine(df, least).first().threshold == want


SAMPLES = "spw_id int, corr int, row_id bigint, chan int, cell_u int, cell_v int, value float"


def test_outliers(spark):
    thr = spark.createDataFrame([(0, 0, 0, 0, 10.0), (0, 0, 1, 0, math.nan), (0, 0, 2, 0, 0.0)], "spw_id int, corr int, cell_u int, cell_v int, threshold float")
    values = [(0, 5.0), (0, 15.0), (0, 10.0), (1, 1.0), (2, -5.0), (2, 5.0), (0, math.nan), (3, 1.0), (0, None)]
    data = spark.createDataFrame([(0, 0, i, 0, u, 0, x) for i, (u, x) in enumerate(values)], SAMPLES)
    judged = {r.row_id: r.outlier for r in flagging.judged(data, thr).collect()}
    assert judged == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False}
    assert {r.row_id for r in flagging.flags(data, thr).collect()} == {1, 3, 5, 7}
    assert {r.row_id for r in flagging.inliers(data, thr).collect()} == {0, 2, 4}
    s = flagging.summary(flagging.judged(data, thr)).first()
    assert (s.n_total, s.n_flagged) == (9, 4)


def test_merge_never_clears(spark):
    main = spark.createDataFrame([(0, [[True, False], [False, False]]), (1, [[False, True], [False, False]])], "row_id bigint, flag array<array<boolean>>")
    new = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 1, 1), (9, 0, 0)], "row_id bigint, chan int, corr int")
    merged = flagging.merge_flags(main, new)
    got = {r.row_id: (r.flag, r.n_new) for r in merged.collect()}
    assert got == {0: ([[True, False], [False, True]], 1), 1: ([[False, True], [False, False]], 0)}
    assert flagging.newly_flagged(merged).first()[0] == 1
