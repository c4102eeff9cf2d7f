"""Tensors as DataFrames: coordinates x0, x1, ... (BIGINT) and a value v."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold import errors as E
from sparkfold.functions import element
from sparkfold.meta import DType, LayoutSpec, product

if TYPE_CHECKING:
    from sparkfold.plans import PlanConfig
    from sparkfold.problem import Problem


def axis(i: int) -> str:
    return f"x{i}"


@dataclass(frozen=True)
class Made:
    """op_D(alpha * op_A(A) op_B(B)) of a problem, not rounded on the way."""

    problem: Problem
    a: Tensor
    b: Tensor
    alpha: complex
    #: How it was planned, and the counts of a choice by counted rows.
    config: PlanConfig
    counted: object = None


@dataclass(frozen=True)
class Tensor:
    """``dense``: every coordinate has exactly one row. Otherwise an absent coordinate counts as 0.

    ``raw``: rows of which ``df`` is the sums by coordinate, for what sums them anyway. ``made``: the product that ``df``
    is, for what needs the same product. Both are gone when ``df`` is replaced."""

    df: DataFrame
    dims: tuple[int, ...]
    dtype: DType
    dense: bool = False
    raw: DataFrame | None = None
    made: Made | None = None

    @property
    def rank(self) -> int:
        return len(self.dims)

    def replace(self, **changes) -> Tensor:
        return replace(self, **({"raw": None, "made": None} if "df" in changes else {}) | changes)

    def unsummed(self) -> Tensor:
        """The tensor by its raw rows, if it has such: the same sums, but coordinates may repeat."""
        return self if self.raw is None else self.replace(df=self.raw)

    def to_df(self, names: Sequence[str] | None = None, value: str = "v") -> DataFrame:
        names = names or [axis(i) for i in range(self.rank)]
        return self.df.select(*[F.col(axis(i)).alias(n) for i, n in enumerate(names)], F.col("v").alias(value))

    def check(self) -> Tensor:
        """Raises unless coordinates are unique, in range and not null, values not null, and all there if dense."""
        axes = [axis(i) for i in range(self.rank)]
        wrong = F.col("v").isNull()
        for x, d in zip(axes, self.dims, strict=True):
            wrong = wrong | F.col(x).isNull() | (F.col(x) < 0) | (F.col(x) >= d)
        rows, bad = self.df.agg(F.count("*"), F.count(F.when(wrong, 1))).first()
        distinct = self.df.select(*axes).distinct().count() if axes else min(rows, 1)
        if bad or distinct != rows or (self.dense and rows != product(self.dims)):
            raise E.NotDense(f"{rows} rows, {distinct} coordinates, {bad} out of range or null; extents {self.dims}")
        return self


def _key(c: Column) -> Column:
    return c.cast("long")


def _raise(message: str) -> Column:
    return F.raise_error(F.lit(f"BadCoordinate: {message}"))


def from_table(
    df: DataFrame, axes: Sequence[Column | str], value: Column | str, dims: Sequence[int], dtype: DType | str = "f64", dense: bool = False, invalid: str = "raise"
) -> Tensor:
    """Sums the rows of each coordinate, so coordinates come out unique.

    ``invalid``: rows with a null coordinate or value, or a coordinate outside its extent, make the query fail
    ("raise"), or go ("drop").
    """
    dtype = DType.of(dtype)
    if invalid not in ("raise", "drop"):
        raise E.OptionError(f"invalid {invalid!r}")
    cols = [_key(F.col(a) if isinstance(a, str) else a) for a in axes]
    x = element(F.col(value) if isinstance(value, str) else value, dtype)
    names = [axis(i) for i in range(len(cols))]
    parts = [x.re.alias("_re")] + ([x.im.alias("_im")] if x.im is not None else [])
    values = [c for c in ("_re", "_im")[: len(parts)]]
    rows = df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], *parts)
    inside = [(F.col(n).isNotNull() & (F.col(n) >= 0) & (F.col(n) < d), n) for n, d in zip(names, dims, strict=True)]
    if invalid == "drop":
        for good, _ in inside:
            rows = rows.where(good)
        rows = rows.dropna(subset=values)
    else:
        checked = [F.when(good, F.col(n)).otherwise(_raise(f"axis {n} null or not below {d}")).alias(n) for (good, n), d in zip(inside, dims, strict=True)]
        rows = rows.select(*checked, *[F.coalesce(F.col(c), _raise("null value")).alias(c) for c in values])
    out = rows.groupBy(*names).agg(*[F.sum(c).alias(c) for c in values])
    v = F.struct(F.col("_re").cast(dtype.part).alias("re"), F.col("_im").cast(dtype.part).alias("im")) if dtype.complex else F.col("_re").cast(dtype.part)
    # Single precision is rounded after summing.
    raw = None if dtype.single else rows.select(*names, v.alias("v"))
    return Tensor(out.select(*names, v.alias("v")), tuple(dims), dtype, dense, raw)


def coordinate(key: str, stride: int, extent: int) -> Column:
    """An axis out of a linear key, in 64-bit integers."""
    c = F.expr(f"{key} div {stride}L") if stride != 1 else F.col(key)
    return F.pmod(c, F.lit(max(extent, 1)).cast("long"))


def grid(spark: SparkSession, dims: Sequence[int]) -> DataFrame:
    """All coordinates in row-major order with their number ``o``."""
    n = product(dims)
    layout = LayoutSpec.row_major(dims)
    cols = [coordinate("id", s, d).alias(axis(i)) for i, (d, s) in enumerate(zip(dims, layout.strides, strict=True))]
    return spark.range(n).select(F.col("id").alias("o"), *cols)


def position(layout: LayoutSpec) -> Column:
    out = F.lit(layout.offset).cast("long")
    for i, s in enumerate(layout.strides):
        out = out + F.col(axis(i)) * F.lit(s).cast("long")
    return out


def from_strided(flat: DataFrame, layout: LayoutSpec, dtype: DType | str = "f64") -> Tensor:
    """Reads a flat buffer (pos, v) through a layout; reversed and broadcast strides included. A position that the layout
    reaches and the buffer lacks, or holds as null, makes the query fail."""
    layout.span()
    dtype = DType.of(dtype)
    at = grid(flat.sparkSession, layout.dims).withColumn("pos", position(layout)).drop("o")
    out = at.join(flat.select(F.col("pos").cast("long").alias("pos"), "v"), "pos", "left")
    v = F.coalesce(F.col("v"), _raise("the buffer lacks a position of the layout"))
    return Tensor(out.select(*[axis(i) for i in range(layout.rank)], v.alias("v")), layout.dims, dtype, True)


def to_strided(t: Tensor, layout: LayoutSpec) -> DataFrame:
    """(pos, v) of the elements a layout puts in a flat buffer."""
    if layout.dims != t.dims:
        raise E.Mismatch(f"{layout.dims} for {t.dims}")
    return t.df.select(position(layout).alias("pos"), "v")


def from_numpy(spark: SparkSession, array, dtype: DType | str | None = None) -> Tensor:
    """A NumPy array (or what ``numpy.from_dlpack`` takes) by way of Arrow."""
    import numpy as np
    import pyarrow as pa

    if not isinstance(array, np.ndarray):
        array = np.from_dlpack(array)
    kinds = {"float32": DType.F32, "float64": DType.F64, "complex64": DType.C32, "complex128": DType.C64}
    if dtype is None and str(array.dtype) not in kinds:
        raise E.DatatypeUnsupported(str(array.dtype))
    dtype = DType.of(dtype) if dtype is not None else kinds[str(array.dtype)]
    index = np.indices(array.shape).reshape(array.ndim, array.size)
    flat = array.reshape(-1)
    cols = {axis(i): pa.array(index[i].astype(np.int64)) for i in range(array.ndim)}
    part = np.float32 if dtype.single else np.float64
    if dtype.complex:
        cols |= {"_re": pa.array(flat.real.astype(part)), "_im": pa.array(flat.imag.astype(part) if np.iscomplexobj(flat) else np.zeros(flat.size, part))}
    else:
        cols["v"] = pa.array(flat.astype(part))
    names = list(cols)
    schema = ", ".join(f"{n} {'long' if n.startswith('x') else dtype.part}" for n in names)
    df = spark.createDataFrame(pa.table(cols).to_pandas(), schema) if flat.size else spark.createDataFrame([], schema)
    if dtype.complex:
        df = df.select(*[n for n in names if n.startswith("x")], F.struct(F.col("_re").alias("re"), F.col("_im").alias("im")).alias("v"))
    return Tensor(df, tuple(array.shape), dtype, True)


def to_numpy(t: Tensor, fill: float = 0.0):
    """The whole tensor on the driver; for small ones."""
    import numpy as np

    out = np.full(t.dims, fill, {"f32": np.float32, "f64": np.float64, "c32": np.complex64, "c64": np.complex128}[t.dtype.value])
    for r in t.df.collect():
        v = r["v"]
        out[tuple(r[axis(i)] for i in range(t.rank))] = complex(v["re"], v["im"]) if t.dtype.complex else v
    return out


def small_ints(spark: SparkSession, dims: Sequence[int], seed: int, dtype: DType | str = "f64") -> Tensor:
    """Integers -6 to 6 by position: sums of products stay exact."""
    dtype = DType.of(dtype)
    value = (F.pmod(F.lit(5) * F.col("o") + F.lit(3 * seed), F.lit(13)) - 6).cast("double")
    other = (F.pmod(F.lit(7) * F.col("o") + F.lit(seed + 1), F.lit(11)) - 5).cast("double")
    v = F.struct(value.cast(dtype.part).alias("re"), other.cast(dtype.part).alias("im")) if dtype.complex else value.cast(dtype.part)
    return Tensor(grid(spark, dims).select(*[axis(i) for i in range(len(dims))], v.alias("v")), tuple(dims), dtype, True)


def check_sink(path: str, inputs: Sequence[DataFrame]) -> None:
    """Refuses an output path that is, holds or lies in an input's path."""
    def norm(p: str) -> str:
        return re.sub("/+", "/", p.split(":", 1)[-1]).rstrip("/") + "/"

    out = norm(path)
    for df in inputs:
        for f in df.inputFiles():
            if norm(f).startswith(out) or out.startswith(norm(f)):
                raise E.OutputOverlapsInput(f"{path} and {f}")


def write_tensor(t: Tensor, path: str, inputs: Sequence[DataFrame] = ()) -> None:
    check_sink(path, inputs)
    t.df.write.parquet(path)


def read_corpus(text: str) -> list[dict]:
    """Contraction shapes from JSON entries {name, op, dtype, a{dims,strides}, b, lc, rc, lb, rb, conj}."""
    from sparkfold.meta import DotGeneral

    out = []
    for x in json.loads(text):
        if x.get("op", "dot_general") != "dot_general":
            raise E.OptionError(f"op {x['op']!r}")
        layouts = {n: LayoutSpec(tuple(x[n]["dims"]), tuple(x[n].get("strides") or LayoutSpec.row_major(x[n]["dims"]).strides)) for n in ("a", "b")}
        out.append({"name": x["name"], "dtype": DType.of(x["dtype"]), **layouts, "spec": DotGeneral(x.get("lc", ()), x.get("rc", ()), x.get("lb", ()), x.get("rb", ())), "conj": tuple(x.get("conj", (False, False)))})
    return out
