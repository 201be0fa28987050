"""Schemas of the tables.  A complex number is a struct of two floats."""

COMPLEX = "struct<re: float, im: float>"
CUBE = f"array<array<{COMPLEX}>>"
VISIBILITIES = f"row_id bigint, time double, spw_id int, field_id int, uvw array<double>, data {CUBE}, flag array<array<boolean>>"
SPECTRAL_WINDOWS = "spw_id int, chan_freqs array<double>, ref_freq double, n_chan int, n_corr int"
ANTENNAS = "antenna_id int, x double, y double, z double"
SAMPLES = "spw_id int, corr int, row_id bigint, chan int, u double, v double, cell_u int, cell_v int, value float"
CELLS = "spw_id int, corr int, cell_u int, cell_v int, n bigint, median float, std float"
FLAGS = "spw_id int, corr int, row_id bigint, chan int"

PAIR = ["spw_id", "corr"]
CELL = [*PAIR, "cell_u", "cell_v"]
