"""One query per operator over the fixtures, and the same in SQL."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.config import FlagConfig
from fringeworks.functions import coords
from fringeworks.functions.quantity import quantity_of
from fringeworks.operators import flagging, gridexport, samples, stats, thresholds
from fringeworks.plans import fixtures as fx
from fringeworks.schema import CELL
from fringeworks.sources import cache, visibilities

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


_C = "299792458.0::DOUBLE"
# Shared steps of the SQL side.
_FLAT = """s0 AS (SELECT event_id AS row_id, ((event_id*7919)%801-400)::DOUBLE/4 AS u0, ((event_id*104729)%601-300)::DOUBLE/4 AS v0, value::FLOAT AS value FROM events),
s1 AS (SELECT row_id, CASE WHEN v0<0 THEN 0.0::DOUBLE-u0 ELSE u0 END AS u, CASE WHEN v0<0 THEN 0.0::DOUBLE-v0 ELSE v0 END AS v, value FROM s0),
samples AS (SELECT 0 AS spw_id, 0 AS corr, row_id, 0 AS chan, u, v, round_even(u/10.0::DOUBLE,0)::INT+10 AS cell_u, round_even(v/10.0::DOUBLE,0)::INT AS cell_v, value FROM s1)"""
_CUBE = f"""spw AS (SELECT x::INT AS spw_id FROM range(2) t(x)),
m AS (SELECT vec_id AS row_id, (vec_id%2)::INT AS spw_id, label AS field_id, ((vec_id*7919)%4001-2000)::DOUBLE/4 AS um, ((vec_id*104729)%3001-1500)::DOUBLE/4 AS vm, embedding AS e FROM embeddings),
cube AS (SELECT row_id, m.spw_id, field_id, um, vm, c.chan::INT AS chan, p.corr::INT AS corr, 1.0e9::DOUBLE + m.spw_id*5.0e8::DOUBLE + c.chan*1.0e6::DOUBLE AS freq,
  e[(c.chan*2+p.corr)*2+1]::FLOAT AS re, e[(c.chan*2+p.corr)*2+2]::FLOAT AS im, (row_id*31+c.chan*7+p.corr*3)%20=0 AS flag FROM m JOIN spw USING (spw_id), range(16) c(chan), range(2) p(corr)),
k0 AS (SELECT *, um*(freq/{_C}) AS u0, vm*(freq/{_C}) AS v0 FROM cube WHERE NOT flag),
k1 AS (SELECT spw_id, corr, row_id, chan, field_id, CASE WHEN v0<0 THEN 0.0::DOUBLE-u0 ELSE u0 END AS u, CASE WHEN v0<0 THEN 0.0::DOUBLE-v0 ELSE v0 END AS v, re, CASE WHEN v0<0 THEN -im ELSE im END AS im FROM k0),
samples AS (SELECT spw_id, corr, row_id, chan, field_id, u, v, round_even(u/250.0::DOUBLE,0)::INT+11 AS cell_u, round_even(v/250.0::DOUBLE,0)::INT AS cell_v, re, im, sqrt(re::DOUBLE*re::DOUBLE+im::DOUBLE*im::DOUBLE)::FLOAT AS value FROM k1)"""
_DENSE = "samples AS (SELECT 0 AS spw_id, 0 AS corr, (l_partkey%21)::INT AS cell_u, (l_suppkey%11)::INT AS cell_v, l_extendedprice::FLOAT AS value FROM lineitem)"
_K = "spw_id, corr, cell_u, cell_v"


def _stats(src: str, out: str) -> str:
    """CTEs that end with ``out``: the hybrid statistics of ``src``."""
    p = out + "_"
    quant = lambda share, name: f"arg_min(lo+(bin+(n*{share}::DOUBLE-(cum-k))/k)*width, bin) FILTER (WHERE cum>=n*{share}::DOUBLE) AS {name}"
    return f"""{p}v AS (SELECT * FROM {src} WHERE value IS NOT NULL AND NOT isnan(value)),
{p}r AS (SELECT {_K}, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM {p}v GROUP BY ALL),
{p}x AS (SELECT {_K}, value, n FROM {p}v JOIN {p}r USING ({_K}) WHERE n<=32),
{p}xm AS (SELECT {_K}, n, median(value::DOUBLE)::FLOAT AS median FROM {p}x GROUP BY ALL),
{p}xs AS (SELECT {_K}, m.n, m.median, (1.4826::FLOAT::DOUBLE*median(abs(value::DOUBLE-m.median::DOUBLE)::FLOAT::DOUBLE)::FLOAT::DOUBLE)::FLOAT AS std FROM {p}x JOIN {p}xm m USING ({_K}) GROUP BY ALL),
{p}b AS (SELECT {_K}, n, vmin::DOUBLE AS lo, (CASE WHEN vmax>vmin THEN vmax::DOUBLE ELSE vmin::DOUBLE+1 END - vmin::DOUBLE) AS rng, value::DOUBLE AS x FROM {p}v JOIN {p}r USING ({_K}) WHERE n>32),
{p}h AS (SELECT {_K}, n, lo, rng/256 AS width, least(greatest(floor((x-lo)/rng*256),0),255)::INT AS bin, count(*) AS k FROM {p}b GROUP BY ALL),
{p}c AS (SELECT *, sum(k) OVER (PARTITION BY {_K} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM {p}h),
{p}q AS (SELECT {_K}, n, {quant(0.5, 'q2')}, {quant(0.25, 'q1')}, {quant(0.75, 'q3')} FROM {p}c GROUP BY {_K}, n),
{out} AS (SELECT {_K}, n, median, std FROM {p}xs UNION ALL SELECT {_K}, n, q2::FLOAT, ((q3-q1)/1.349::DOUBLE)::FLOAT FROM {p}q)"""


def _thresholds(cells: str, out: str, size: float, n: int, widths: tuple[float, ...]) -> str:
    p = out + "_"
    ends, at = [], 0.0
    for w in widths:
        at += w
        ends.append(f"(r>={at}::DOUBLE)::INT")
    mean = lambda over="": f"sum(median::DOUBLE*n){over}/sum(n::DOUBLE){over}+3.0::DOUBLE*(sum(std::DOUBLE*n){over}/sum(n::DOUBLE){over})"
    box = " OVER (PARTITION BY spw_id, corr, tv ORDER BY cell_u RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"""{p}e AS (SELECT c.*, d, cell_v+d AS tv FROM {cells} c, (SELECT unnest([-2,-1,0,1,2]) AS d) s),
{p}w AS (SELECT *, ({mean(box)})::FLOAT AS local_thr, count(*){box}-1 AS n_neighbors FROM {p}e),
{p}l AS (SELECT {_K}, n, median, std, local_thr, n_neighbors, sqrt(((cell_u-{n})*{size}::DOUBLE)*((cell_u-{n})*{size}::DOUBLE)+(cell_v*{size}::DOUBLE)*(cell_v*{size}::DOUBLE)) AS r FROM {p}w WHERE d=0),
{p}g AS (SELECT *, {'+'.join(ends)} AS ring FROM {p}l),
{p}a AS (SELECT spw_id, corr, ring, ({mean()})::FLOAT AS annular_thr FROM {p}g GROUP BY ALL),
{out} AS (SELECT {_K}, n, median, std, local_thr, n_neighbors, ring, annular_thr, CASE WHEN n_neighbors<3 THEN annular_thr ELSE least(local_thr, annular_thr) END AS threshold FROM {p}g JOIN {p}a USING (spw_id, corr, ring))"""


_FLAT_CELLS = f"{_FLAT}, {_stats('samples', 'cells')}"
_FLAT_THR = f"{_FLAT_CELLS}, {_thresholds('cells', 'thr', 10.0, 10, (30.0, 30.0, 65.0))}"
_OUT = "(threshold IS NULL OR isnan(threshold) OR coalesce(NOT isnan(value) AND value>threshold, false))"
_FLAT_JUDGED = f"{_FLAT_THR}, judged AS (SELECT s.*, threshold, {_OUT} AS outlier FROM samples s LEFT JOIN thr t USING ({_K}))"
_AMP = f"{_CUBE}, {_stats('samples', 'cells')}, {_thresholds('cells', 'thr', 250.0, 11, (3000.0, 3000.0, 6500.0))}, fl AS (SELECT s.spw_id, s.corr, s.row_id, s.chan FROM samples s LEFT JOIN thr USING ({_K}) WHERE {_OUT})"


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles in another order may differ in their last bits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in columns})


def _flat_cells(s: SparkSession, d: str) -> DataFrame:
    return stats.hybrid_stats(fx.flat(s, d))


def _flat_thresholds(s: SparkSession, d: str) -> DataFrame:
    return thresholds.thresholds(_flat_cells(s, d), fx.FLAT_CELL, fx.FLAT_N, widths=fx.FLAT_WIDTHS)


def _flat_judged(s: SparkSession, d: str) -> DataFrame:
    return flagging.judged(fx.flat(s, d), _flat_thresholds(s, d))


def _cube_flags(s: SparkSession, d: str) -> DataFrame:
    data = fx.cube_samples(s, d)
    thr = thresholds.thresholds(stats.hybrid_stats(data), fx.CUBE_CELL, fx.CUBE_N)
    return flagging.flags(data, thr)


@_query(f"WITH {_CUBE} SELECT row_id, chan, corr, um*(freq/{_C}) AS u, vm*(freq/{_C}) AS v FROM cube")
def uv_scale(s, d):
    f = F.col("freq")
    return fx.cube(s, d).select("row_id", "chan", "corr", coords.in_wavelengths(F.col("uvw")[0], f).alias("u"), coords.in_wavelengths(F.col("uvw")[1], f).alias("v"))


@_query(f"WITH {_CUBE} SELECT row_id, chan, corr, u, v, re, im FROM k1")
def hermitian_fold(s, d):
    c = fx.cube(s, d).filter(~F.col("flag"))
    c = c.withColumns({"u0": coords.in_wavelengths(F.col("uvw")[0], F.col("freq")), "v0": coords.in_wavelengths(F.col("uvw")[1], F.col("freq"))})
    im = F.when(F.col("v0") < 0, -F.col("im")).otherwise(F.col("im"))
    return c.select("row_id", "chan", "corr", coords.fold(F.col("v0"), F.col("u0")).alias("u"), coords.fold(F.col("v0"), F.col("v0")).alias("v"), "re", im.alias("im"))


@_query(f"WITH {_FLAT} SELECT row_id, u, v, cell_u, cell_v FROM samples")
def cell_assign(s, d):
    return fx.flat(s, d).select("row_id", "u", "v", "cell_u", "cell_v")


@_query(f"WITH {_FLAT} SELECT row_id, cell_u::BIGINT*11+cell_v AS flat_cell FROM samples")
def flat_cell_index(s, d):
    return fx.flat(s, d).select("row_id", coords.flat_cell(F.col("cell_u"), F.col("cell_v"), fx.FLAT_N).alias("flat_cell"))


@_query(f"WITH {_FLAT} SELECT ceil(greatest(max(abs(u)), max(abs(v)))/10.0::DOUBLE)::BIGINT AS half_size FROM samples")
def grid_half_size_data(s, d):
    return fx.flat(s, d).agg(coords.half_size_of(F.col("u"), F.col("v"), fx.FLAT_CELL).alias("half_size"))


_ANT = "a AS (SELECT s_suppkey::INT AS i, ((s_suppkey*7919)%1009)::DOUBLE AS x, ((s_suppkey*104729)%2003)::DOUBLE AS y, ((s_suppkey*31)%53)::DOUBLE AS z FROM supplier), b AS (SELECT max(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) AS m FROM a p JOIN a q ON p.i<q.i)"


@_query(f"WITH {_ANT} SELECT m AS max_baseline_m FROM b")
def max_baseline(s, d):
    return visibilities.max_baseline(fx.antennas(s, d))


@_query(f"WITH {_ANT} SELECT ceil(m*(1.0e9::DOUBLE+5.0e8::DOUBLE+15*1.0e6::DOUBLE)/{_C}/250.0::DOUBLE)::BIGINT AS half_size FROM b")
def grid_half_size_geometry(s, d):
    top = fx.windows(s).agg(F.max(F.array_max("chan_freqs")).alias("top"))
    longest = visibilities.max_baseline(fx.antennas(s, d))
    return longest.join(F.broadcast(top)).select(F.ceil(F.col("max_baseline_m") * F.col("top") / F.lit(coords.SPEED_OF_LIGHT) / F.lit(fx.CUBE_CELL)).alias("half_size"))


def _quantity(name: str, sql: str) -> None:
    def fn(s, d):
        return fx.cube(s, d).select("row_id", "chan", "corr", F.round(quantity_of(F.col("re"), F.col("im"), name).cast("double"), 5).alias("value"))

    QUERIES[f"quantity_{name}"] = fn
    SQL[f"quantity_{name}"] = f"WITH {_CUBE} SELECT row_id, chan, corr, round(({sql})::FLOAT::DOUBLE, 5) AS value FROM cube"


_quantity("amplitude", "sqrt(re::DOUBLE*re::DOUBLE+im::DOUBLE*im::DOUBLE)")
_quantity("phase", "atan2(im::DOUBLE, re::DOUBLE)")
_quantity("real", "re::DOUBLE")
_quantity("imag", "im::DOUBLE")


@_query(f"WITH {_CUBE} SELECT row_id, chan, corr, (re-(re*CASE WHEN chan=0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)::FLOAT)::FLOAT AS re, im FROM cube")
def model_subtract(s, d):
    main = visibilities.with_values(fx.main_table(s, d), "data-model")
    return samples.explode_cube(main, fx.windows(s), "z").select("row_id", "chan", "corr", "re", "im")


_LIT = "(SELECT max(abs(e[i])) > 0 FROM (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1000), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i % 2 = 1)"


@_query(f"""SELECT 'data only' AS columns, 'data' AS data_column UNION ALL SELECT 'model in use', CASE WHEN {_LIT} THEN 'data-model' ELSE 'data' END
UNION ALL SELECT 'model of zeros', CASE WHEN (SELECT max(abs(embedding[1] * 0)) > 0 FROM embeddings) THEN 'data-model' ELSE 'data' END
UNION ALL SELECT 'corrected', CASE WHEN {_LIT} THEN 'corrected_data-model' ELSE 'data' END UNION ALL SELECT 'residual', 'residual' UNION ALL SELECT 'requested', 'MODEL_DATA'""")
def resolve_column(s, d):
    """The column chosen for tables of several sets of columns."""
    main = fx.main_table(s, d)
    nothing = F.transform("model_data", lambda row: F.transform(row, lambda z: F.struct((z["re"] * 0).cast("float").alias("re"), z["im"].alias("im"))))
    tables = {
        "data only": main.drop("model_data"), "model in use": main, "model of zeros": main.withColumn("model_data", nothing),
        "corrected": main.withColumnRenamed("data", "corrected_data"), "residual": main.withColumn("residual", F.col("data")),
    }
    chosen = [(name, visibilities.resolve_column(df)) for name, df in tables.items()]
    return s.createDataFrame([*chosen, ("requested", visibilities.resolve_column(main, "MODEL_DATA"))], "columns string, data_column string")


@_query(f"WITH {_CUBE} SELECT row_id, spw_id, field_id, chan, corr, freq, re, im, flag FROM cube")
def explode_cube(s, d):
    return fx.cube(s, d).drop("uvw")


@_query(f"WITH {_CUBE} SELECT row_id, chan, corr FROM cube WHERE NOT flag")
def filter_unflagged(s, d):
    return fx.cube(s, d).filter(~F.col("flag")).select("row_id", "chan", "corr")


@_query(f"WITH {_CUBE} SELECT spw_id, corr, row_id, chan, cell_u, cell_v FROM samples WHERE u*u+v*v BETWEEN 500.0::DOUBLE*500.0::DOUBLE AND 2000.0::DOUBLE*2000.0::DOUBLE")
def filter_uvrange(s, d):
    return samples.project(fx.cube(s, d), "amplitude", fx.CUBE_CELL, fx.CUBE_N, (500.0, 2000.0)).select("spw_id", "corr", "row_id", "chan", "cell_u", "cell_v")


@_query("SELECT vec_id AS row_id, (vec_id%2)::INT AS spw_id FROM embeddings WHERE vec_id%2=1")
def filter_spw(s, d):
    return samples.select_rows(fx.main_table(s, d), spw_ids=(1,)).select("row_id", "spw_id")


@_query("SELECT vec_id AS row_id, label AS field_id FROM embeddings WHERE label IN (1, 3, 5)")
def filter_field(s, d):
    return samples.select_rows(fx.main_table(s, d), field_ids=(1, 3, 5)).select("row_id", "field_id")


@_query(f"WITH {_CUBE} SELECT DISTINCT row_id, spw_id, 1.0e9::DOUBLE + spw_id*5.0e8::DOUBLE AS ref_freq FROM cube")
def spw_broadcast_join(s, d):
    return fx.main_table(s, d).join(F.broadcast(fx.windows(s)), "spw_id").select("row_id", "spw_id", "ref_freq")


@_query("SELECT vec_id AS row_id FROM embeddings WHERE vec_id%2=0")
def legacy_chunk_scan(s, d):
    return visibilities.scan(fx.dataset(s, d), 0).select("row_id")


@_query("SELECT count(*) AS n_rows FROM embeddings")
def row_count(s, d):
    return fx.main_table(s, d).agg(F.count("*").alias("n_rows"))


@_query("SELECT x::INT AS spw_id, 16 AS n_chan, 2 AS n_corr, 1.0e9::DOUBLE+x*5.0e8::DOUBLE AS ref_freq, 1.0e9::DOUBLE+x*5.0e8::DOUBLE+15*1.0e6::DOUBLE AS top_freq FROM range(2) t(x)")
def spectral_windows(s, d):
    return fx.windows(s).select("spw_id", F.size("chan_freqs").alias("n_chan"), "n_corr", "ref_freq", F.array_max("chan_freqs").alias("top_freq"))


@_query(f"WITH {_FLAT} SELECT {_K}, count(*) AS n FROM samples GROUP BY ALL")
def cell_counts(s, d):
    return stats.cell_counts(fx.flat(s, d))


@_query(f"WITH {_DENSE} SELECT {_K}, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM samples GROUP BY ALL")
def cell_count_min_max(s, d):
    return stats.count_min_max(fx.dense(s, d))


@_query(f"""WITH {_FLAT}, v AS (SELECT * FROM samples WHERE value IS NOT NULL AND NOT isnan(value)), m AS (SELECT {_K}, count(*) AS n, median(value::DOUBLE)::FLOAT AS median FROM v GROUP BY ALL)
SELECT {_K}, m.n, m.median, (1.4826::FLOAT::DOUBLE*median(abs(value::DOUBLE-m.median::DOUBLE)::FLOAT::DOUBLE)::FLOAT::DOUBLE)::FLOAT AS std FROM v JOIN m USING ({_K}) GROUP BY ALL""")
def cell_stats_exact(s, d):
    return stats.exact_stats(fx.flat(s, d))


_DENSE_H = f"""WITH {_DENSE}, r AS (SELECT {_K}, count(*) AS n, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM samples GROUP BY ALL),
b AS (SELECT {_K}, n, lo, CASE WHEN hi>lo THEN hi-lo ELSE 1.0::DOUBLE END AS rng, value::DOUBLE AS x FROM samples JOIN r USING ({_K})),
h AS (SELECT {_K}, n, lo, rng/256 AS width, least(greatest(floor((x-lo)/rng*256),0),255)::INT AS bin, count(*) AS k FROM b GROUP BY ALL)"""


@_query(f"{_DENSE_H} SELECT {_K}, bin, k FROM h")
def cell_histogram(s, d):
    return stats.histogram(stats.with_ranges(fx.dense(s, d))).select(*CELL, "bin", "k")


def _dense_q(share: float, name: str) -> str:
    return f"round(arg_min(lo+(bin+(n*{share}::DOUBLE-(cum-k))/k)*width, bin) FILTER (WHERE cum>=n*{share}::DOUBLE), 3) AS {name}"


@_query(f"{_DENSE_H}, c AS (SELECT *, sum(k) OVER (PARTITION BY {_K} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM h) SELECT {_K}, n, {_dense_q(0.25, 'q1')}, {_dense_q(0.75, 'q3')} FROM c GROUP BY {_K}, n")
def histogram_quantiles(s, d):
    return _r(stats.quantiles(stats.histogram(stats.with_ranges(fx.dense(s, d)))).select(*CELL, "n", "q1", "q3"), "q1", "q3")


@_query(f"WITH {_FLAT_CELLS} SELECT {_K}, n, median, std FROM cells")
def cell_stats_hybrid(s, d):
    return _flat_cells(s, d)


@_query(f"WITH {_DENSE}, {_stats('samples', 'cells')} SELECT {_K}, n, median, std FROM cells")
def cell_stats_dense(s, d):
    return stats.hybrid_stats(fx.dense(s, d))


@_query(f"WITH {_FLAT}, c AS (SELECT {_K}, count(*) AS n FROM samples GROUP BY ALL) SELECT {_K}, n, coalesce(sum(n) OVER (PARTITION BY spw_id, corr ORDER BY cell_u, cell_v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c")
def cell_offsets(s, d):
    return stats.cell_offsets(stats.cell_counts(fx.flat(s, d)))


@_query(f"WITH {_FLAT_THR} SELECT {_K}, n, round(local_thr::DOUBLE, 3) AS local_thr FROM thr")
def local_threshold(s, d):
    return _r(thresholds.neighbourhood(_flat_cells(s, d), 5, 3.0).select(*CELL, "n", "local_thr"), "local_thr")


@_query(f"WITH {_FLAT_THR} SELECT {_K}, n_neighbors FROM thr")
def neighbor_count(s, d):
    return thresholds.neighbourhood(_flat_cells(s, d), 5, 3.0).select(*CELL, "n_neighbors")


@_query(f"WITH {_FLAT_THR} SELECT {_K}, ring FROM thr")
def ring_assign(s, d):
    return thresholds.rings(stats.cell_counts(fx.flat(s, d).filter("value is not null and not isnan(value)")), fx.FLAT_CELL, fx.FLAT_WIDTHS, fx.FLAT_N).select(*CELL, "ring")


@_query(f"WITH {_FLAT_THR} SELECT {_K}, ring, round(annular_thr::DOUBLE, 3) AS annular_thr FROM thr")
def annular_threshold(s, d):
    ringed = thresholds.rings(_flat_cells(s, d), fx.FLAT_CELL, fx.FLAT_WIDTHS, fx.FLAT_N)
    return _r(thresholds.annular(ringed, 3.0).select(*CELL, "ring", "annular_thr"), "annular_thr")


@_query(f"WITH {_FLAT_THR} SELECT {_K}, n_neighbors, ring, round(threshold::DOUBLE, 3) AS threshold FROM thr")
def combined_threshold(s, d):
    return _r(_flat_thresholds(s, d).select(*CELL, "n_neighbors", "ring", "threshold"), "threshold")


@_query(f"WITH {_FLAT_JUDGED} SELECT spw_id, corr, row_id, chan FROM judged WHERE outlier")
def flag_samples(s, d):
    return flagging.flags(fx.flat(s, d), _flat_thresholds(s, d))


@_query(f"WITH {_FLAT_JUDGED} SELECT spw_id, corr, count(*) AS n_total, count(*) FILTER (WHERE outlier) AS n_flagged, round(count(*) FILTER (WHERE outlier)*100.0::DOUBLE/count(*), 6) AS pct_flagged FROM judged GROUP BY ALL")
def flag_summary(s, d):
    return flagging.summary(_flat_judged(s, d))


@_query(f"WITH {_FLAT_JUDGED} SELECT spw_id, corr, count(*) AS n_total, count(*) FILTER (WHERE outlier) AS n_flagged FROM judged GROUP BY ROLLUP (spw_id, corr)")
def flag_rollup(s, d):
    return flagging.rollup_summary(_flat_judged(s, d))


@_query(f"WITH {_FLAT_JUDGED} SELECT row_id, cell_u, cell_v, value FROM judged WHERE NOT outlier AND NOT isnan(value) AND value<=threshold")
def unflagged_samples(s, d):
    return flagging.inliers(fx.flat(s, d), _flat_thresholds(s, d)).select("row_id", "cell_u", "cell_v", "value")


_AFTER = f"WITH {_FLAT_JUDGED}, kept AS (SELECT {_K}, value FROM judged WHERE NOT isnan(value) AND value<=threshold), {_stats('kept', 'later')}"


@_query(f"{_AFTER} SELECT {_K}, n, median, std FROM later")
def cell_stats_after(s, d):
    return stats.hybrid_stats(flagging.inliers(fx.flat(s, d), _flat_thresholds(s, d)))


_MERGED = f"WITH {_AMP}, merged AS (SELECT c.row_id, c.chan, c.corr, c.flag AS old, c.flag OR f.row_id IS NOT NULL AS new FROM cube c LEFT JOIN fl f ON c.row_id=f.row_id AND c.chan=f.chan AND c.corr=f.corr)"


@_query(f"{_MERGED} SELECT row_id, count(*) FILTER (WHERE new) AS n_flags, count(*) FILTER (WHERE new AND NOT old) AS n_new FROM merged GROUP BY row_id")
def flag_writeback(s, d):
    merged = flagging.merge_flags(fx.main_table(s, d), _cube_flags(s, d))
    ones = F.aggregate("flag", F.lit(0).cast("bigint"), lambda a, row: a + F.size(F.filter(row, lambda f: f)))
    return merged.select("row_id", ones.alias("n_flags"), "n_new")


@_query(f"{_MERGED} SELECT count(*) FILTER (WHERE new AND NOT old) AS newly_flagged FROM merged")
def newly_flagged_count(s, d):
    return flagging.newly_flagged(flagging.merge_flags(fx.main_table(s, d), _cube_flags(s, d)))


@_query(f"""WITH {_FLAT_THR}, frame AS (SELECT 0 AS spw_id, 0 AS corr, a.x::INT AS cell_u, b.x::INT AS cell_v FROM range(21) a(x), range(11) b(x))
SELECT {_K}, coalesce(n, 0) AS n, coalesce(median, 0)::FLOAT AS median, coalesce(std, 0)::FLOAT AS std FROM frame LEFT JOIN cells USING ({_K})""")
def dense_grid(s, d):
    return gridexport.dense_grid(_flat_cells(s, d), fx.FLAT_N)


@_query(f"{_AFTER} SELECT min(median)::DOUBLE AS vmin, max(median)::DOUBLE AS vmax FROM (SELECT median FROM cells UNION ALL SELECT median FROM later) WHERE median<>0 AND isfinite(median)")
def plot_scale_range(s, d):
    return gridexport.scale_range(_flat_cells(s, d), cell_stats_after(s, d))


_TIMED = "t0 AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey)-1 AS row_id, epoch(o_orderdate)::DOUBLE AS time FROM orders)"


@_query(f"WITH {_TIMED}, s AS (SELECT time, min(row_id) AS first_row, count(*) AS n_rows FROM t0 GROUP BY time) SELECT time, first_row, lead(first_row) OVER (ORDER BY first_row) AS next_row, n_rows FROM s")
def time_boundaries(s, d):
    return visibilities.time_boundaries(fx.timed_rows(s, d))


@_query(f"""WITH {_TIMED}, s AS (SELECT time, min(row_id) AS f FROM t0 GROUP BY time), r AS (SELECT f, row_number() OVER (ORDER BY f)-1 AS k, count(*) OVER () AS n FROM s),
c AS (SELECT least(k // CASE WHEN n<=7 THEN 1 ELSE n // 7 END, least(n, 7)-1)::INT AS chunk, min(f) AS start_row FROM r GROUP BY 1)
SELECT chunk, start_row, coalesce(lead(start_row) OVER (ORDER BY start_row), (SELECT count(*) FROM t0))-start_row AS n_rows FROM c""")
def row_chunks(s, d):
    return visibilities.row_chunks(fx.timed_rows(s, d), 7)


@_query(f"WITH {_FLAT} SELECT {_K}, count(*) AS n FROM samples GROUP BY ALL")
def shard_union_counts(s, d):
    """Counts over three shards read one after the other equal those over all."""
    parts = [fx.flat(s, d).filter(F.pmod("row_id", F.lit(3)) == i) for i in range(3)]
    return stats.cell_counts(cache.merge_shards(parts))


@_query(f"WITH {_FLAT} SELECT count(*) AS outside FROM samples WHERE abs(cell_u-10)>10 OR cell_v<0 OR cell_v>10")
def grid_bounds_check(s, d):
    """Samples whose cell lies outside the grid."""
    return fx.flat(s, d).agg(F.count_if((F.abs(F.col("cell_u") - fx.FLAT_N) > fx.FLAT_N) | (F.col("cell_v") < 0) | (F.col("cell_v") > fx.FLAT_N)).alias("outside"))


@_query(f"WITH {_FLAT} SELECT row_id, rank() OVER (ORDER BY cell_u, cell_v) AS place FROM samples")
def cell_order(s, d):
    """Samples in cell order, as a counting sort would place them; ties share a place."""
    data = fx.flat(s, d)
    offsets = stats.cell_offsets(stats.cell_counts(data)).select(*CELL, (F.col("first") + 1).alias("place"))
    return data.join(offsets, CELL).select("row_id", "place")


@_query(f"WITH {_AMP} SELECT spw_id, corr, count(*) AS n_flags FROM fl GROUP BY ALL")
def cube_flag_counts(s, d):
    return _cube_flags(s, d).groupBy("spw_id", "corr").agg(F.count("*").alias("n_flags"))


def _cache(s: SparkSession) -> cache.ResultCache:
    """A cache for one query, in the folder all machines share; it goes with the session."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    store = cache.ResultCache(s, f"{root.rstrip('/')}/cache-{uuid.uuid4().hex}")
    atexit.register(store.delete_quietly)
    return store


@_query(f"WITH {_FLAT} SELECT {_K}, count(*) AS n FROM samples GROUP BY ALL")
def cache_roundtrip(s, d):
    """Counts over samples that went through the cache's files."""
    return stats.cell_counts(_cache(s).store("samples", fx.flat(s, d)))


@_query(f"WITH {_CUBE} SELECT spw_id, corr, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM samples GROUP BY ALL")
def cache_append(s, d):
    """Samples appended to the cache in three parts."""
    store, data = _cache(s), fx.cube_samples(s, d)
    for k in range(3):
        store.append("samples", data.filter(F.pmod("row_id", F.lit(3)) == k))
    return store.load("samples", data.schema).groupBy("spw_id", "corr").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@_query(f"WITH {_CUBE}, {_stats('samples', 'cells')} SELECT {_K}, n, median, std FROM cells WHERE spw_id = 1 AND corr = 0")
def cache_grid_load(s, d):
    """The cells of one window and correlation, from a cache opened for reading."""
    store, cells = _cache(s).create(d, FlagConfig(), coords.grid_shape(fx.CUBE_N), fx.windows(s)), stats.hybrid_stats(fx.cube_samples(s, d))
    store.store("cells", cells)
    return cache.open_readonly(s, store.path).load("cells", cells.schema, spw_id=1, corr=0).select(*cells.columns)


@_query(f"WITH {_FLAT}, first AS (SELECT {_K}, count(*) AS n FROM samples GROUP BY ALL) SELECT {_K}, n*2 AS n FROM first")
def cache_overwrite(s, d):
    """A grid stored twice: the second replaces the first."""
    store, counts = _cache(s), stats.cell_counts(fx.flat(s, d))
    store.store("counts", counts.filter("n > 1"))
    return store.store("counts", counts.withColumn("n", F.col("n") * 2))


@_query("""SELECT 25.0::DOUBLE AS cell_size, 4.5::DOUBLE AS nsigma, '[100.0, 50000.0]' AS uvrange, 2*ceil(50000.0::DOUBLE/25)::BIGINT+1 AS n_u, ceil(50000.0::DOUBLE/25)::BIGINT+1 AS n_v, w.*
FROM (SELECT x::INT AS spw_id, 1.0e9::DOUBLE+x*5.0e8::DOUBLE AS ref_freq, 16 AS n_chan, 2 AS n_corr FROM range(2) t(x)) w""")
def cache_metadata(s, d):
    """Grid shape from a uv range, options and windows, as a cache gives them back."""
    config = FlagConfig(cell_size=25.0, nsigma=4.5, uvrange=(100.0, 50000.0))
    store = _cache(s).create(d, config, coords.grid_shape(coords.half_size(config.uvrange[1], config.cell_size)), fx.windows(s))
    back, (n_u, n_v) = cache.open_readonly(s, store.path), store.grid_shape()
    known = back.config()
    fixed = [F.lit(known.cell_size).alias("cell_size"), F.lit(known.nsigma).alias("nsigma"), F.lit(str(list(known.uvrange))).alias("uvrange"), F.lit(n_u).cast("bigint").alias("n_u"), F.lit(n_v).cast("bigint").alias("n_v")]
    return back.windows().select(*fixed, "spw_id", "ref_freq", "n_chan", "n_corr")


@_query(f"""WITH {_FLAT}, c AS (SELECT DISTINCT {_K} FROM samples WHERE value IS NOT NULL AND NOT isnan(value)), g AS (SELECT a.x::INT AS cell_u, b.x::INT AS cell_v FROM range(21) a(x), range(11) b(x))
SELECT spw_id, corr, g.cell_u, g.cell_v, count(*) FILTER (WHERE g.cell_u<>c.cell_u OR g.cell_v<>c.cell_v) AS n_neighbors FROM g JOIN c ON abs(g.cell_u-c.cell_u)<=2 AND abs(g.cell_v-c.cell_v)<=2 GROUP BY ALL""")
def neighbor_map(s, d):
    """Occupied neighbours of every cell of the grid, empty cells included."""
    return thresholds.neighbour_map(_flat_cells(s, d), 5, fx.FLAT_N)
