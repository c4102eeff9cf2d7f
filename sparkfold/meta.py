"""Descriptions of tensors and contractions: element types, layouts, operands, labels."""

from __future__ import annotations

import enum
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from sparkfold import errors as E

LONG = 2**63 - 1


class DType(enum.Enum):
    F32 = "f32"
    F64 = "f64"
    C32 = "c32"
    C64 = "c64"

    @staticmethod
    def of(x: DType | str) -> DType:
        try:
            return x if isinstance(x, DType) else DType(x)
        except ValueError:
            raise E.DatatypeUnsupported(f"{x!r}: element types are f32, f64, c32 and c64") from None

    @property
    def complex(self) -> bool:
        return self in (DType.C32, DType.C64)

    @property
    def single(self) -> bool:
        return self in (DType.F32, DType.C32)

    @property
    def part(self) -> str:
        return "float" if self.single else "double"

    @property
    def sql(self) -> str:
        return f"struct<re:{self.part},im:{self.part}>" if self.complex else self.part

    @property
    def flops(self) -> int:
        """Of a multiply-add."""
        return 8 if self.complex else 2


class Op(enum.Enum):
    IDENTITY = "identity"
    CONJUGATE = "conjugate"


def product(dims: Sequence[int]) -> int:
    return math.prod(dims)


@dataclass(frozen=True)
class LayoutSpec:
    """Extents, signed element strides and offset of a flat buffer."""

    dims: tuple[int, ...]
    strides: tuple[int, ...]
    offset: int = 0

    def __post_init__(self):
        object.__setattr__(self, "dims", tuple(self.dims))
        object.__setattr__(self, "strides", tuple(self.strides))
        if len(self.dims) != len(self.strides):
            raise E.LayoutRank(f"{len(self.dims)} extents, {len(self.strides)} strides")
        for d in self.dims:
            if d < 0:
                raise E.NegativeExtent(str(d))
        if any(abs(x) > LONG for x in (*self.dims, *self.strides, self.offset)):
            raise E.Overflow("layout")

    @staticmethod
    def row_major(dims: Sequence[int]) -> LayoutSpec:
        strides, s = [], 1
        for d in reversed(dims):
            strides.append(s)
            s *= max(d, 1)
        return LayoutSpec(tuple(dims), tuple(reversed(strides)))

    @staticmethod
    def col_major(dims: Sequence[int]) -> LayoutSpec:
        strides, s = [], 1
        for d in dims:
            strides.append(s)
            s *= max(d, 1)
        return LayoutSpec(tuple(dims), tuple(strides))

    @property
    def rank(self) -> int:
        return len(self.dims)

    def span(self) -> tuple[int, int] | None:
        """Least and greatest element offset; None of an empty layout."""
        if 0 in self.dims:
            return None
        ends = [s * (d - 1) for d, s in zip(self.dims, self.strides, strict=True)]
        low, high = self.offset + sum(e for e in ends if e < 0), self.offset + sum(e for e in ends if e > 0)
        if not -LONG <= low <= high <= LONG // 16:
            raise E.Overflow("address range")
        return low, high

    def replace(self, **changes) -> LayoutSpec:
        return replace(self, **changes)


def is_injective_layout(layout: LayoutSpec) -> bool:
    """Conservative: in order of size, every stride must step over all that the smaller ones reach."""
    if 0 in layout.dims:
        return True
    reach = 0
    for s, d in sorted((abs(s), d) for d, s in zip(layout.dims, layout.strides, strict=True) if d > 1):
        if s <= reach:
            return False
        reach += s * (d - 1)
    return True


@dataclass(frozen=True)
class OperandSpec:
    layout: LayoutSpec
    op: Op = Op.IDENTITY

    @staticmethod
    def of(dims: Sequence[int], op: Op = Op.IDENTITY) -> OperandSpec:
        return OperandSpec(LayoutSpec.row_major(dims), op)

    @property
    def dims(self) -> tuple[int, ...]:
        return self.layout.dims


@dataclass(frozen=True)
class CSpec:
    """Where beta's operand comes from: nowhere, D itself, or a tensor of its own."""

    kind: str = "absent"
    op: Op = Op.IDENTITY
    operand: OperandSpec | None = None

    @staticmethod
    def absent() -> CSpec:
        return CSpec()

    @staticmethod
    def output(op: Op = Op.IDENTITY) -> CSpec:
        return CSpec("output", op)

    @staticmethod
    def separate(operand: OperandSpec) -> CSpec:
        return CSpec("separate", operand.op, operand)


@dataclass(frozen=True)
class Labels:
    """One label a mode, for A, B, D and a separate C."""

    a: tuple[int, ...]
    b: tuple[int, ...]
    d: tuple[int, ...]
    c: tuple[int, ...] | None = None

    def __post_init__(self):
        for n in ("a", "b", "d"):
            object.__setattr__(self, n, tuple(getattr(self, n)))
        if self.c is not None:
            object.__setattr__(self, "c", tuple(self.c))


def einsum_labels(spec: str, c: str | None = None) -> Labels:
    """Labels of ``"ik,kj->ij"``."""
    try:
        left, d = spec.replace(" ", "").split("->")
        a, b = left.split(",")
    except ValueError:
        raise E.ConfigError(f"{spec!r} is not of the form a,b->d") from None
    return Labels(*(tuple(map(ord, x)) for x in (a, b, d)), tuple(map(ord, c)) if c is not None else None)


@dataclass(frozen=True)
class DotGeneral:
    """Paired contraction and batch axes; D's modes are A's free, B's free, then the batch."""

    lhs_contract: tuple[int, ...] = ()
    rhs_contract: tuple[int, ...] = ()
    lhs_batch: tuple[int, ...] = ()
    rhs_batch: tuple[int, ...] = ()

    def __post_init__(self):
        for n in ("lhs_contract", "rhs_contract", "lhs_batch", "rhs_batch"):
            object.__setattr__(self, n, tuple(getattr(self, n)))

    def labels(self, a_dims: Sequence[int], b_dims: Sequence[int]) -> Labels:
        for x, y in ((self.lhs_contract, self.rhs_contract), (self.lhs_batch, self.rhs_batch)):
            if len(x) != len(y):
                raise E.AxisListLength(f"{x} and {y}")
        for axes, dims in ((self.lhs_contract + self.lhs_batch, a_dims), (self.rhs_contract + self.rhs_batch, b_dims)):
            for x in axes:
                if not 0 <= x < len(dims):
                    raise E.AxisOutOfRange(f"{x} of {len(dims)}")
            if len(set(axes)) != len(axes):
                raise E.AxisRepeated(str(axes))
        pairs = list(zip(self.lhs_contract + self.lhs_batch, self.rhs_contract + self.rhs_batch, strict=True))
        for x, y in pairs:
            if a_dims[x] != b_dims[y]:
                raise E.PairedExtent(f"axis {x} has {a_dims[x]}, axis {y} has {b_dims[y]}")
        a = list(range(len(a_dims)))
        b = list(range(len(a_dims), len(a_dims) + len(b_dims)))
        for x, y in pairs:
            b[y] = a[x]
        used_a, used_b = {x for x, _ in pairs}, {y for _, y in pairs}
        d = [a[i] for i in range(len(a_dims)) if i not in used_a] + [b[i] for i in range(len(b_dims)) if i not in used_b]
        return Labels(a, b, d + [a[x] for x in self.lhs_batch])
