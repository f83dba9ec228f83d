"""HDF5 files through h5py, where it is installed: whole datasets by the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from gridframe.grid import GridFrame
from gridframe.sources.create import array


def save_hdf5(path: str, arrays: Mapping[str, GridFrame], attrs: Mapping | None = None) -> None:
    import h5py

    with h5py.File(path, "w") as f:
        for name, a in arrays.items():
            f.create_dataset(name, data=a.to_numpy())
        f.attrs.update(dict(attrs or {}))


def load_hdf5(spark: SparkSession, path: str, names: Sequence[str] | None = None, **options) -> tuple[dict[str, GridFrame], dict]:
    """The named datasets (all of the top level, if none are named) and the file's attributes."""
    import h5py

    with h5py.File(path, "r") as f:
        found = names or [k for k, v in f.items() if isinstance(v, h5py.Dataset)]
        return {k: array(spark, f[k][()], **options) for k in found}, dict(f.attrs)
