"""One file opened by itself: variables by name, as arrays, with their attributes.

This is the small-file way in; everything is read through the driver, as the
file is one file. For many or large files see skyloom.sources.files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from skyloom.operators import meta
from skyloom.sources.files import attributes_of, decoded, first_file, metadata_rows, read
from skyloom.sources.layout import File


class Accessor:
    """A variable: accessor[...] is the whole array, accessor[i] a part of it, attrs its attributes."""

    def __init__(self, path: str, file: File, name: str):
        self.path, self.name, self._file = path, name, file
        v = file.variables[name]
        self.attrs = attributes_of(file).get(name, {})
        self.info = {"data_type": v.type, "num_elems": v.elements, "rec_vary": v.record_varies, "dim_varys": v.dim_varies, "num_dims": len(v.dims), "dim_sizes": v.dims, "rec_num": v.last_record + 1, "var_num": v.number}

    def __getitem__(self, key) -> np.ndarray:
        data = self._file.read(self.name)
        data = np.char.rstrip(np.char.decode(data, "ascii", "replace"), " \0") if data.dtype.kind == "S" else data
        return data if key is Ellipsis else data[key]

    def __repr__(self) -> str:
        #: The two labels of the first lines.
        lines = [f"CDF filename : {self.path}", f"CDF variable name: {self.name}"]
        return "\n".join([*lines, *(f"{k} : {v}" for k, v in self.info.items())]) + "\n"


class Opened:
    """A file, usable in a with statement (leaving it changes nothing)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.file = first_file(spark, path)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        return None

    def __contains__(self, name: str) -> bool:
        return name in self.file.variables

    def __getitem__(self, name: str) -> Accessor:
        if name not in self.file.variables:
            raise KeyError(name)
        return Accessor(self.path, self.file, name)

    @property
    def data(self) -> dict[str, np.ndarray]:
        return {n: self[n][...] for n in self.file.variables}

    @property
    def meta(self) -> dict[str, dict]:
        return attributes_of(self.file)

    def inquire(self) -> dict[str, object]:
        """What the whole file is like."""
        f = self.file
        z = sum(v.is_z for v in f.variables.values())
        return {"num_dims": len(f.rdims), "dim_sizes": f.rdims, "encoding": f.encoding, "majority": "ROW" if f.row_major else "COLUMN", "max_rec": max((v.last_record for v in f.variables.values()), default=-1), "num_r_vars": len(f.variables) - z, "num_z_vars": z, "num_attrs": len(f.attributes)}

    def to_frames(self, flatten: bool = True, labels: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(the time series by Epoch, the metadata table); 1-D variables are spread over columns unless flatten is off."""
        names = [v.name for v in self.file.variables.values() if v.record_varies]
        sizes = {n: self.file.variables[n].shape[0] for n in names if len(self.file.variables[n].shape) == 1 and self.file.variables[n].shape[0] > 1}
        series = meta.time_series(decoded(read(self.spark, self.path, names)).drop("file"), sizes, flatten)
        rows = self.spark.createDataFrame(metadata_rows(self.file), "variable string, attribute string, value string")
        return series, meta.metadata(rows, labels)
