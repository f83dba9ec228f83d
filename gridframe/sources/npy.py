"""The .npy format: a partitioned reader and a writer, as a Spark data source.

Reading: the driver reads the header, and each task maps its own range of cells.
Writing: every task writes its cells at their place in a file that has its full
length from the start, and the driver commits or removes it. Paths must be ones that
the driver and the executors have mounted, named plainly or as file: URIs.
"""

from __future__ import annotations

import ast
import math
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridframe.functions import dtypes
from gridframe.grid import GridFrame
from gridframe.plans.index import axes

MAGIC = b"\x93NUMPY"
CELLS_PER_TASK = 4_000_000


def mounted(path: str) -> str:
    """The path of a file: URI."""
    return re.sub("^file:(//)?(?=/)", "", path)


def read_header(path: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """dtype, shape, whether in Fortran order, and where the data begin."""
    with open(path, "rb") as f:
        if f.read(6) != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        major = f.read(2)[0]
        length = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
        made = ast.literal_eval(f.read(length).decode("latin1" if major < 3 else "utf8"))
        return np.dtype(made["descr"]), tuple(made["shape"]), made["fortran_order"], f.tell()


def header(dtype, shape: tuple[int, ...]) -> bytes:
    """A version 1.0 header, or 2.0 if it is too long for one."""
    made = repr({"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": tuple(shape)}).encode("latin1")
    for version, size in ((b"\x01\x00", "<H"), (b"\x02\x00", "<I")):
        start = len(MAGIC) + 2 + struct.calcsize(size)
        text = made + b" " * (-(start + len(made) + 1) % 64) + b"\n"
        if len(text) < 2**16 or size == "<I":
            return MAGIC + version + struct.pack(size, len(text)) + text
    raise AssertionError


class NpyRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task
        self.dtype, self.shape, self.fortran, self.offset = read_header(path)

    def partitions(self) -> list[NpyRange]:
        size = math.prod(self.shape)
        return [NpyRange(a, min(size, a + self.per_task)) for a in range(0, size, self.per_task)] or [NpyRange(0, 0)]

    def read(self, partition: NpyRange) -> Iterator[pa.RecordBatch]:
        from gridframe.sources.create import value_array

        if partition.stop == partition.start:
            return
        data = np.memmap(self.path, self.dtype, "r", self.offset, (math.prod(self.shape),))
        order = self.shape[::-1] if self.fortran else self.shape
        for a in range(partition.start, partition.stop, 100_000):
            b = min(partition.stop, a + 100_000)
            where = np.unravel_index(np.arange(a, b), order) if order else ()
            where = where[::-1] if self.fortran else where
            v = np.ascontiguousarray(data[a:b]).astype(self.dtype.newbyteorder("="))
            yield pa.RecordBatch.from_arrays([*[pa.array(np.asarray(w, np.int64)) for w in where], value_array(v)], names=[*axes(len(self.shape)), "v"])


class NpySource(DataSource):
    """spark.read.format("npy").load(path): i0, ..., v."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        dtype, shape, _, _ = read_header(mounted(self.options["path"]))
        return ", ".join([*(f"{i} bigint" for i in axes(len(shape))), f"v {dtypes.spark_type(dtype)}"])

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        shape = tuple(int(n) for n in self.options["shape"].split(",") if n)
        return NpyWriter(mounted(self.options["path"]), np.dtype(self.options["dtype"]), shape)

    def reader(self, schema) -> NpyReader:
        return NpyReader(mounted(self.options["path"]), int(self.options.get("cells_per_task", CELLS_PER_TASK)))


def load(spark: SparkSession, path: str, dims=None, unit=None, **options) -> GridFrame:
    """A grid of a .npy file, in C or Fortran order."""
    from gridframe.sources.create import layout_for

    spark.dataSource.register(NpySource)
    dtype, shape, _, _ = read_header(mounted(path))
    return GridFrame(spark.read.format("npy").load(path), F.col("v"), layout_for(shape, **options), dtype.newbyteorder("="), dims, unit)


class NpyCount(WriterCommitMessage):
    def __init__(self, cells: int):
        self.cells = cells


class NpyWriter(DataSourceArrowWriter):
    """Tasks write their cells at their places in a file of full length beside the path.
    A retried or speculative task writes the same bytes at the same places. The file
    takes its name when all tasks are done and every cell was written; a job that fails
    leaves none."""

    def __init__(self, path: str, dtype: np.dtype, shape: tuple[int, ...]):
        self.path, self.dtype, self.shape = path, dtype, shape
        self.temporary, self.head = f"{path}.{uuid.uuid4().hex}.partial", header(dtype, shape)
        with open(self.temporary, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + math.prod(shape) * dtype.itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> NpyCount:
        n = 0
        with open(self.temporary, "r+b") as f:
            for batch in iterator:
                at = np.zeros(batch.num_rows, np.int64)
                for i, length in zip(axes(len(self.shape)), self.shape):
                    at = at * length + batch.column(i).to_numpy()
                order = np.argsort(at)
                at, values = at[order], dtypes.from_arrow(batch.column("v"), self.dtype)[order]
                runs = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                for x, y in zip(runs.tolist(), np.r_[runs[1:], len(at)].tolist()):
                    if x < y:
                        f.seek(len(self.head) + int(at[x]) * self.dtype.itemsize)
                        f.write(values[x:y].tobytes())
                n += len(at)
            f.flush()
            os.fsync(f.fileno())
        return NpyCount(n)

    def commit(self, messages: list[NpyCount | None]) -> None:
        written = sum(m.cells for m in messages if m)
        if written != math.prod(self.shape):
            raise ValueError(f"{written} of {math.prod(self.shape)} cells were written")
        os.replace(self.temporary, self.path)

    def abort(self, messages: list[NpyCount | None]) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


def save(a: GridFrame, path: str) -> None:
    """Write a grid as a .npy file in C order, ghosts left out."""
    a.spark.dataSource.register(NpySource)
    rows = a.df.repartitionByRange(max(1, -(-a.size // CELLS_PER_TASK)), *a.index) if a.ndim else a.df
    descr = np.lib.format.dtype_to_descr(a.dtype)
    rows.write.format("npy").mode("append").option("dtype", descr).option("shape", ",".join(map(str, a.shape))).save(path)
