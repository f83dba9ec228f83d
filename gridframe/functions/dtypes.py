"""NumPy types as Spark types. Integers of every width are kept as BIGINT (the
widest unsigned as DECIMAL(20,0)), complex numbers as a struct of two doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLEX = "struct<re:double,im:double>"


def spark_type(dtype) -> str:
    dtype = np.dtype(dtype)
    if dtype.kind == "b":
        return "boolean"
    if dtype.kind == "u" and dtype.itemsize == 8:
        return "decimal(20,0)"
    if dtype.kind in "iu":
        return "bigint"
    if dtype.kind == "f":
        return "float" if dtype.itemsize <= 4 else "double"
    if dtype.kind == "c":
        return COMPLEX
    raise TypeError(f"{dtype} has no Spark type here")


def numpy_type(spark: str) -> np.dtype:
    """The NumPy type of a Spark column type's name."""
    kinds = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", COMPLEX: "complex128"}
    if spark.startswith("decimal"):
        return np.dtype("uint64" if spark == "decimal(20,0)" else "float64")
    if spark not in kinds:
        raise TypeError(f"a column of {spark} is no array")
    return np.dtype(kinds[spark])


def from_arrow(v: pa.Array, dtype) -> np.ndarray:
    """Values of a column of spark_type(dtype) as a NumPy array of dtype."""
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        return (v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False)).astype(dtype)
    if dtype == np.uint64:
        return np.array([int(x) for x in v.to_pylist()], np.uint64)
    return v.to_numpy(zero_copy_only=False).astype(dtype)


def literal(x) -> Column:
    """A number as a column."""
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, complex):
        return F.struct(F.lit(x.real).alias("re"), F.lit(x.imag).alias("im"))
    return F.lit(x)


def wrapped(value: Column, dtype) -> Column:
    """An integer brought into a narrower type's range, as NumPy wraps it."""
    dtype = np.dtype(dtype)
    if dtype.kind not in "iu" or dtype.itemsize == 8:
        return value
    span = 2 ** (8 * dtype.itemsize)
    if dtype.kind == "u":
        return F.pmod(value, F.lit(span))
    return F.pmod(value + F.lit(span // 2), F.lit(span)) - F.lit(span // 2)


def cast(value: Column, old, new) -> Column:
    """A value of NumPy type `old` as one of `new`: floats are cut towards zero,
    integers wrap, complex numbers drop what is imaginary."""
    old, new = np.dtype(old), np.dtype(new)
    if old.kind == "c" and new.kind != "c":
        value, old = value["re"], np.dtype(float)
    if new.kind == "c":
        return value if old.kind == "c" else F.struct(value.cast("double").alias("re"), F.lit(0.0).alias("im"))
    if new.kind == "b":
        return value if old.kind == "b" else value.cast("double") != 0.0
    if new.kind in "iu":
        whole = value.cast("int").cast("bigint") if old.kind == "b" else value.cast("bigint")
        return wrapped(whole, new).cast(spark_type(new))
    return value.cast("int").cast(spark_type(new)) if old.kind == "b" else value.cast(spark_type(new))


def complex_parts(value: Column, dtype) -> tuple[Column, Column]:
    if np.dtype(dtype).kind == "c":
        return value["re"], value["im"]
    return cast(value, dtype, float), F.lit(0.0)


def make_complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))
