"""Validation and roles, without Spark."""

import pytest

from sparkfold import errors as E
from sparkfold.meta import CSpec, DotGeneral, DType, Labels, LayoutSpec, OperandSpec, is_injective_layout
from sparkfold.plans import Plan, PlanConfig, TileCatalog, list_strategies
from sparkfold.problem import Problem
from sparkfold.sources import read_corpus


def of(*dims):
    return OperandSpec.of(dims)


def test_roles():
    p = Problem.einsum("f64", "hikr,hkjs->hij", (2, 3, 4, 5), (2, 4, 6, 7))
    chars = lambda x: "".join(map(chr, x))
    assert [chars(x) for x in (p.h, p.m, p.n, p.k, p.alone_a, p.alone_b)] == ["h", "i", "j", "k", "r", "s"]
    assert p.macs == 2 * 3 * 4 * 5 * 6 * 7 and not p.all_batch and p.c_matches_d
    assert Problem.einsum("f64", "ij,ji->ij", (2, 3), (3, 2)).all_batch


@pytest.mark.parametrize(
    ("error", "make"),
    [
        (E.LayoutRank, lambda: LayoutSpec((1, 2), (1,))),
        (E.NegativeExtent, lambda: LayoutSpec((-1,), (1,))),
        (E.Overflow, lambda: LayoutSpec((2**40,), (2**40,)).span()),
        (E.Overflow, lambda: Problem.einsum("f64", "abc,a->bc", (2**30, 2**30, 2**30), (2**30,))),
        (E.LabelCount, lambda: Problem.from_labels("f64", of(2, 3), of(3), CSpec.output(), of(2), Labels((1,), (3,), (1,)))),
        (E.ExtentMismatch, lambda: Problem.einsum("f64", "ik,kj->ij", (2, 3), (4, 2))),
        (E.ExtentMismatch, lambda: Problem.einsum("f64", "ii,ij->j", (2, 3), (2, 2))),
        (E.OutputLabelMismatch, lambda: Problem.einsum("f64", "ik,kj->ij", (2, 3), (3, 4), c=CSpec.separate(of(2)), c_labels="i")),
        (E.CLabels, lambda: Problem.einsum("f64", "ik,kj->ij", (2, 3), (3, 4), c=CSpec.separate(of(2, 4)))),
        (E.OutputOnlyLabel, lambda: Problem.einsum("f64", "ik,kj->ijz", (2, 3), (3, 4))),
        (E.OutputOnlyLabel, lambda: Problem.from_labels("f64", of(2), of(2), CSpec.output(), of(1), Labels((1,), (1,), (2,)))),
        (E.OutputNotInjective, lambda: Problem.from_labels("f64", of(2, 3), of(3, 2), CSpec.output(), OperandSpec(LayoutSpec((2, 2), (1, 0))), Labels((1, 2), (2, 3), (1, 3)))),
        (E.AxisListLength, lambda: DotGeneral((0,), ()).labels((2,), (2,))),
        (E.AxisOutOfRange, lambda: DotGeneral((2,), (0,)).labels((2,), (2,))),
        (E.AxisRepeated, lambda: DotGeneral((0, 0), (0, 1)).labels((2, 2), (2, 2))),
        (E.PairedExtent, lambda: DotGeneral((0,), (0,)).labels((2,), (3,))),
        (E.OutputExtents, lambda: Problem.from_dot_general("f64", of(2, 3), of(3, 4), of(4, 2), DotGeneral((1,), (0,)))),
        (E.DatatypeUnsupported, lambda: Problem.einsum("bf16", "i,i->i", (2,), (2,))),
    ],
)
def test_typed_errors(error, make):
    with pytest.raises(error):
        make()


def test_errors_come_before_shortcuts():
    """An empty problem with an output that isn't injective is still an error."""
    with pytest.raises(E.OutputNotInjective):
        Problem.from_labels("f64", of(2, 0), of(0, 2), CSpec.output(), OperandSpec(LayoutSpec((2, 2), (1, 1))), Labels((1, 2), (2, 3), (1, 3)))


def test_injective_layouts():
    assert is_injective_layout(LayoutSpec((3, 4), (-1, -3), 11))
    assert is_injective_layout(LayoutSpec((5, 1, 4), (1, 0, 7)))
    assert not is_injective_layout(LayoutSpec((3, 4), (1, 2)))
    assert is_injective_layout(LayoutSpec((0, 4), (0, 0)))


def test_config_is_honoured_or_refused():
    p = Problem.einsum("f64", "ik,kj->ij", (2, 3), (3, 4))
    assert Plan(p, PlanConfig(strategy="block_gemm")).algorithm == "block_gemm.f64"
    assert Plan(p).report.macs == 24
    for error, config in (
        (E.StrategyRefused, PlanConfig(strategy="elementwise")),
        (E.StrategyRefused, PlanConfig(strategy="join_agg.f32")),
        (E.StrategyRefused, PlanConfig(complex_method="3m")),
        (E.OptionError, PlanConfig(strategy="other")),
        (E.OptionError, PlanConfig(orient="up")),
        (E.NotPositive, PlanConfig(block_size=0)),
        (E.StrategyRefused, PlanConfig(strategy="block_gemm", no_materialize=True)),
    ):
        with pytest.raises(error):
            Plan(p, config)
    with pytest.raises(E.DtypeMismatch):
        Plan(p, dtype=DType.F32)
    assert len(list_strategies()) == 12


def test_selector_and_catalog():
    p = Problem.einsum("f64", "ik,kj->ij", (2, 3), (3, 4))
    seen = []
    assert Plan(p, selector=lambda q, c: seen.append((q, c)) or c[-1]).algorithm == "block_gemm.f64"
    assert len(seen) == 1
    with pytest.raises(E.SelectError):
        Plan(p, selector=lambda q, c: "none")
    with pytest.raises(E.SelectError):
        TileCatalog().admit("4m", None)
    assert E.OutputOnlyLabel("x").is_unsupported and not E.Overflow("x").is_unsupported


def test_corpus_reader():
    (x,) = read_corpus('[{"name": "m", "op": "dot_general", "dtype": "f64", "a": {"dims": [2, 3], "strides": [1, 2]}, "b": {"dims": [3, 4]}, "lc": [1], "rc": [0]}]')
    assert x["a"].strides == (1, 2) and x["b"].strides == (4, 1) and x["spec"].lhs_contract == (1,)
