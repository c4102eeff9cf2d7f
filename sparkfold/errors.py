"""Typed errors. Every check runs on metadata, before any DataFrame is planned."""

from __future__ import annotations


class TensorError(Exception):
    """Root; ``status`` is a small code for callers that report by number."""

    status = 1

    @property
    def is_unsupported(self) -> bool:
        return isinstance(self, Unsupported)


class ConfigError(TensorError):
    status = 2


class ShapeError(TensorError):
    status = 3


class LayoutError(TensorError):
    status = 4


class AliasError(TensorError):
    status = 5


class Unsupported(TensorError):
    status = 6


class SelectError(TensorError):
    status = 7


class ExecError(TensorError):
    status = 8


class BackendError(TensorError):
    status = 9


def _kind(name: str, base: type[TensorError], doc: str) -> type[TensorError]:
    return type(name, (base,), {"__doc__": doc, "__module__": __name__})


LayoutRank = _kind("LayoutRank", ShapeError, "dims and strides differ in length")
NegativeExtent = _kind("NegativeExtent", ShapeError, "an extent is below zero")
Overflow = _kind("Overflow", ShapeError, "an extent product or address leaves 64 bits")
LabelCount = _kind("LabelCount", ShapeError, "labels and modes differ in number")
ExtentMismatch = _kind("ExtentMismatch", ShapeError, "one label has two extents")
OutputLabelMismatch = _kind("OutputLabelMismatch", ShapeError, "C and D have different label sets")
AxisListLength = _kind("AxisListLength", ShapeError, "paired axis lists differ in length")
AxisOutOfRange = _kind("AxisOutOfRange", ShapeError, "an axis is not one of the operand's")
AxisRepeated = _kind("AxisRepeated", ShapeError, "an axis is listed twice")
PairedExtent = _kind("PairedExtent", ShapeError, "paired axes differ in extent")
OutputExtents = _kind("OutputExtents", ShapeError, "D's extents are not the contraction's")
NotAPermutation = _kind("NotAPermutation", ShapeError, "not a permutation of the axes")
CLabels = _kind("CLabels", ConfigError, "C has labels exactly if it is separate")
OptionError = _kind("OptionError", ConfigError, "an option has no such value")
NotPositive = _kind("NotPositive", ConfigError, "an option must be positive")
Mismatch = _kind("Mismatch", LayoutError, "an operand is not what the plan was made for")
CMode = _kind("CMode", LayoutError, "the source of C is not the planned one")
DtypeMismatch = _kind("DtypeMismatch", LayoutError, "element types differ")
NotDense = _kind("NotDense", LayoutError, "a dense operand lacks or repeats coordinates, or holds nulls")
OutputNotInjective = _kind("OutputNotInjective", AliasError, "two output indices share an element")
OutputOverlapsInput = _kind("OutputOverlapsInput", AliasError, "the sink lies in an input")
OutputOnlyLabel = _kind("OutputOnlyLabel", Unsupported, "a label of D is in neither A nor B")
DatatypeUnsupported = _kind("DatatypeUnsupported", Unsupported, "no such element type")
StrategyRefused = _kind("StrategyRefused", Unsupported, "the requested strategy can't do this problem")
WouldMaterialize = _kind("WouldMaterialize", Unsupported, "operands would be copied against the requirement")
BadCoordinate = _kind("BadCoordinate", LayoutError, "a coordinate or value is null, or a coordinate out of range")
