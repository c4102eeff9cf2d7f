"""A validated contraction: roles of its labels and the facts a plan needs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from sparkfold import errors as E
from sparkfold.meta import LONG, CSpec, DotGeneral, DType, Labels, LayoutSpec, Op, OperandSpec, is_injective_layout, product


def _reduced(spec: OperandSpec, labels: Sequence[int], name: str) -> dict[int, int]:
    """Label -> extent, with repeated labels merged."""
    if len(labels) != spec.layout.rank:
        raise E.LabelCount(f"{name} has {spec.layout.rank} modes and {len(labels)} labels")
    out: dict[int, int] = {}
    for label, d in zip(labels, spec.dims, strict=True):
        if out.setdefault(label, d) != d:
            raise E.ExtentMismatch(f"label {label} of {name}: {out[label]} and {d}")
    if 0 not in out.values() and product(out.values()) > LONG:
        raise E.Overflow(f"extent product of {name}")
    spec.layout.span()
    return out


def _diagonal_layout(layout: LayoutSpec, labels: Sequence[int]) -> LayoutSpec:
    """The layout over distinct labels: strides of a repeated label add."""
    strides: dict[int, int] = {}
    dims: dict[int, int] = {}
    for label, d, s in zip(labels, layout.dims, layout.strides, strict=True):
        strides[label] = strides.get(label, 0) + s
        dims[label] = d
    return LayoutSpec(tuple(dims.values()), tuple(strides.values()), layout.offset)


@dataclass(frozen=True)
class Problem:
    """Made by ``from_labels`` and ``from_dot_general`` only. h, m, n, k: labels by role; alone_a, alone_b: K labels of
    one operand only."""

    dtype: DType
    a: OperandSpec
    b: OperandSpec
    c: CSpec
    d: OperandSpec
    labels: Labels
    extents: tuple[tuple[int, int], ...]
    h: tuple[int, ...]
    m: tuple[int, ...]
    n: tuple[int, ...]
    k: tuple[int, ...]
    alone_a: tuple[int, ...]
    alone_b: tuple[int, ...]
    c_matches_d: bool

    @property
    def extent(self) -> dict[int, int]:
        return dict(self.extents)

    def size(self, labels: Sequence[int]) -> int:
        e = self.extent
        return product(e[x] for x in labels)

    @property
    def macs(self) -> int:
        return product(self.extent.values())

    @property
    def all_batch(self) -> bool:
        return not (self.m or self.n or self.k or self.alone_a or self.alone_b)

    @property
    def output_labels(self) -> tuple[int, ...]:
        return tuple(dict.fromkeys(self.labels.d))

    @property
    def output_empty(self) -> bool:
        return self.size(self.output_labels) == 0

    @property
    def contraction_empty(self) -> bool:
        return self.size(self.k + self.alone_a + self.alone_b) == 0

    @property
    def output_diagonal(self) -> bool:
        return len(self.output_labels) != len(self.labels.d)

    @staticmethod
    def from_labels(dtype: DType | str, a: OperandSpec, b: OperandSpec, c: CSpec, d: OperandSpec, labels: Labels) -> Problem:
        dtype = DType.of(dtype)
        in_a, in_b, in_d = _reduced(a, labels.a, "A"), _reduced(b, labels.b, "B"), _reduced(d, labels.d, "D")
        if (c.kind == "separate") != (labels.c is not None):
            raise E.CLabels("C has labels exactly if it is separate")
        in_c = _reduced(c.operand, labels.c, "C") if c.kind == "separate" else {}
        extent: dict[int, int] = {}
        for name, own in (("A", in_a), ("B", in_b), ("D", in_d), ("C", in_c)):
            for label, x in own.items():
                if extent.setdefault(label, x) != x:
                    raise E.ExtentMismatch(f"label {label}: {extent[label]} and, in {name}, {x}")
        if c.kind == "separate" and set(in_c) != set(in_d):
            raise E.OutputLabelMismatch(f"C has {sorted(in_c)}, D has {sorted(in_d)}")
        for label in in_d:
            if label not in in_a and label not in in_b:
                raise E.OutputOnlyLabel(str(label))
        if not is_injective_layout(_diagonal_layout(d.layout, labels.d)):
            raise E.OutputNotInjective(str(d.layout))
        both = [x for x in in_a if x in in_b]
        matches = c.kind == "output" or (
            c.kind == "separate" and {x: s for x, s in zip(labels.c, c.operand.layout.strides, strict=True)} == {x: s for x, s in zip(labels.d, d.layout.strides, strict=True)}
            and c.operand.layout.offset == d.layout.offset
        )
        return Problem(
            dtype, a, b, c, d, labels, tuple(extent.items()),
            h=tuple(x for x in both if x in in_d), m=tuple(x for x in in_a if x in in_d and x not in in_b), n=tuple(x for x in in_b if x in in_d and x not in in_a),
            k=tuple(x for x in both if x not in in_d), alone_a=tuple(x for x in in_a if x not in in_b and x not in in_d), alone_b=tuple(x for x in in_b if x not in in_a and x not in in_d),
            c_matches_d=matches,
        )

    @staticmethod
    def from_dot_general(dtype: DType | str, a: OperandSpec, b: OperandSpec, d: OperandSpec | None, spec: DotGeneral) -> Problem:
        labels = spec.labels(a.dims, b.dims)
        extent = dict(zip(labels.a, a.dims, strict=True)) | dict(zip(labels.b, b.dims, strict=True))
        dims = tuple(extent[x] for x in labels.d)
        if d is None:
            d = OperandSpec.of(dims)
        if d.dims != dims:
            raise E.OutputExtents(f"D is {d.dims}, the contraction {dims}")
        return Problem.from_labels(dtype, a, b, CSpec.output(), d, labels)

    @staticmethod
    def einsum(dtype: DType | str, spec: str, a_dims: Sequence[int], b_dims: Sequence[int], conj: str = "", c: CSpec | None = None, c_labels: str | None = None) -> Problem:
        """Of ``"ik,kj->ij"`` over row-major operands; ``conj`` names the conjugated ones among a, b, c and d."""
        from sparkfold.meta import einsum_labels

        labels = einsum_labels(spec, c_labels)
        op = {x: Op.CONJUGATE if x in conj else Op.IDENTITY for x in "abcd"}
        if len(labels.a) != len(a_dims) or len(labels.b) != len(b_dims):
            raise E.LabelCount(f"{spec} for {a_dims} and {b_dims}")
        extent = dict(zip(labels.a, a_dims, strict=True)) | dict(zip(labels.b, b_dims, strict=True))
        missing = [x for x in labels.d if x not in extent]
        if missing:
            raise E.OutputOnlyLabel(str(missing))
        d = OperandSpec.of([extent[x] for x in labels.d], op["d"])
        c = c or CSpec.output(op["c"])
        return Problem.from_labels(dtype, OperandSpec.of(a_dims, op["a"]), OperandSpec.of(b_dims, op["b"]), c, d, labels)
