"""A stand-in for a table library: a folder with one .npy file per column."""

import os

import numpy as np


class table:  # noqa: N801
    def __init__(self, path, readonly=True):
        self.path, self.readonly = path.replace("::", "/"), readonly

    def colnames(self):
        return [f.removesuffix(".npy") for f in os.listdir(self.path) if f.endswith(".npy")]

    def nrows(self):
        return len(np.load(f"{self.path}/{self.colnames()[0]}.npy", mmap_mode="r"))

    def getcol(self, name, start=0, count=None):
        column = np.load(f"{self.path}/{name}.npy")
        return column[start:] if count is None else column[start : start + count]

    def putcol(self, name, values, start, count):
        assert not self.readonly and len(values) == count
        column = np.load(f"{self.path}/{name}.npy")
        column[start : start + count] = values
        np.save(f"{self.path}/{name}.npy", column)

    def close(self):
        pass
