"""Scalar expressions over elements: real numbers, or complex ones as two columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfold.meta import DType


@dataclass(frozen=True)
class Num:
    """A number in double precision; ``im`` is None for real types."""

    re: Column
    im: Column | None = None

    def conj(self) -> Num:
        return self if self.im is None else Num(self.re, -self.im)

    def __add__(self, y: Num) -> Num:
        return Num(self.re + y.re, None if self.im is None else self.im + y.im)

    def __mul__(self, y: Num) -> Num:
        if self.im is None:
            return Num(self.re * y.re)
        return Num(self.re * y.re - self.im * y.im, self.re * y.im + self.im * y.re)

    def norm(self) -> Column:
        return F.abs(self.re) if self.im is None else F.sqrt(self.re * self.re + self.im * self.im)

    def map(self, f) -> Num:
        return Num(f(self.re), None if self.im is None else f(self.im))

    def pack(self, dtype: DType) -> Column:
        if not dtype.complex:
            return self.re.cast(dtype.part)
        return F.struct(self.re.cast(dtype.part).alias("re"), self.im.cast(dtype.part).alias("im"))


def element(v: Column, dtype: DType) -> Num:
    if not dtype.complex:
        return Num(v.cast("double"))
    return Num(v.getField("re").cast("double"), v.getField("im").cast("double"))


def number(x: complex, dtype: DType) -> Num:
    x = complex(x)
    return Num(F.lit(x.real), F.lit(x.imag)) if dtype.complex else Num(F.lit(x.real))


def scaled(y: Num, x: complex, dtype: DType) -> Num:
    """x * y, with unit factors left out."""
    if x == 1:
        return y
    if complex(x).imag == 0:
        return y.map(lambda c: c * F.lit(complex(x).real))
    return number(x, dtype) * y
