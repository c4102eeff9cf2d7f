"""Plans: a strategy chosen once for a problem, run lazily on any operands of its description."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from sparkfold import errors as E
from sparkfold import operators as X
from sparkfold.meta import CSpec, DType, Labels, Op, OperandSpec
from sparkfold.problem import Problem
from sparkfold.functions import element, scaled
from sparkfold.sources import Made, Tensor, axis

STRATEGIES = ("elementwise", "join_agg", "block_gemm")
#: Multiply-adds from which rows are counted before a choice that is left to the plan; below it no choice matters.
COUNT_MACS = 512**3
#: Fixed estimates of the choice, in microseconds: a joined product, which is sent to be summed, a cell packed, a packed
#: cell sent to a block, a block's call, a block's multiply-add, and a product of two single cells of a block.
JOINED, PACKED, SENT, CALLED, MULTIPLIED, SINGLE = 0.3, 2.0, 0.1, 300.0, 0.0002, 0.04


@dataclass(frozen=True)
class PlanConfig:
    """What is asked for is honoured or refused."""

    strategy: str = "auto"
    #: None: as large as memory and the number of tasks allow.
    block_size: int | None = None
    complex_method: str = "4m"
    deterministic: bool = False
    strict_nonfinite: bool = False
    orient: str = "rule"
    partitions: int | None = None
    no_materialize: bool = False
    #: Partitions the work is dealt into; None leaves it to Spark.
    #: no_materialize refuses strategies that copy operands (blocks).
    #: "sparse" leaves out elements that no term reaches; the result is then a tensor whose absent elements are 0.
    density: str = "dense"
    #: Sparse results of a real type keep only elements that are at least this.
    least: float | None = None

    def validate(self) -> None:
        if self.strategy != "auto" and self.strategy.split(".")[0] not in STRATEGIES:
            raise E.OptionError(f"strategy {self.strategy!r}")
        if self.complex_method not in ("4m", "3m"):
            raise E.OptionError(f"complex_method {self.complex_method!r}")
        if self.density not in ("dense", "sparse"):
            raise E.OptionError(f"density {self.density!r}")
        if self.orient not in ("ab", "ba", "rule"):
            raise E.OptionError(f"orient {self.orient!r}")
        if self.least is not None and self.density != "sparse":
            raise E.OptionError("least is for sparse results")
        for name in ("block_size", "partitions"):
            x = getattr(self, name)
            if x is not None and x < 1:
                raise E.NotPositive(f"{name} = {x}")


@dataclass(frozen=True)
class PlanReport:
    algorithm: str
    m: int
    n: int
    k: int
    batch: int
    macs: int
    flops: int
    est_rows: int
    partitions: int | None
    materialized: bool
    rewrites: tuple[str, ...]
    #: Of a choice by counted rows: products that the join would make (at least so many, where both sides are the same and
    #: this decides), microseconds of both, keys that are split.
    join_rows: int | None = None
    join_cost: float | None = None
    block_cost: float | None = None
    hot_keys: int = 0


@dataclass(frozen=True)
class Diagnostics:
    """What a prepared contraction says of itself; materialized: which of A, B and C it copies."""

    backend: str
    algorithm: str
    materialized: tuple[bool, bool, bool] = (False, False, False)


@dataclass(frozen=True)
class PlanningBudget:
    """How many tasks are to run at once, at least 1: work is dealt into three times as many partitions."""

    tasks: int = 1

    def partitions(self) -> int:
        return 3 * max(1, self.tasks)

    @staticmethod
    def of(spark) -> PlanningBudget:
        return PlanningBudget(spark.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class _Counted:
    algorithm: str
    join_rows: int
    join_cost: float
    block_cost: float
    hot: object = None
    hot_keys: int = 0
    #: Blocks of a side, where both are the same.
    listed: int | None = None


@dataclass
class TileCatalog:
    """Tile functions by name; a caller's own catalog may hold more than the built-in ones."""

    tiles: dict[str, X.TileFunction] = field(default_factory=lambda: {"4m": X.multiply, "3m": X.multiply_3m})

    def admit(self, name: str, f: X.TileFunction) -> TileCatalog:
        if name in self.tiles:
            raise E.SelectError(f"{name!r} is taken")
        return TileCatalog(self.tiles | {name: f})

    def union(self, other: TileCatalog) -> TileCatalog:
        return TileCatalog(self.tiles | other.tiles)


def candidates(p: Problem) -> list[str]:
    """Strategies that can do the problem, the rule's choice first."""
    dtype = p.dtype.value
    if p.all_batch:
        return [f"elementwise.{dtype}", f"join_agg.{dtype}"]
    return [f"join_agg.{dtype}"] + ([f"block_gemm.{dtype}"] if p.k else [])


def list_strategies() -> list[str]:
    return [f"{s}.{d.value}" for s in STRATEGIES for d in DType]


Selector = Callable[[Problem, list[str]], str]


class Plan:
    def __init__(self, problem: Problem, config: PlanConfig | None = None, selector: Selector | None = None, catalog: TileCatalog | None = None, dtype: DType | str | None = None):
        self.problem, self.config, self.catalog = problem, config or PlanConfig(), catalog or TileCatalog()
        self.config.validate()
        if dtype is not None and DType.of(dtype) != problem.dtype:
            raise E.DtypeMismatch(f"{dtype} for {problem.dtype.value}")
        able = [x for x in candidates(problem) if not (self.config.no_materialize and x.startswith("block_gemm"))]
        #: Left to the operands: counted when they are known.
        self.open = False
        self.counted: _Counted | None = None
        if selector is not None:
            self.algorithm = selector(problem, list(able))
            if self.algorithm not in able:
                raise E.SelectError(f"{self.algorithm!r} is not one of {able}")
        elif self.config.strategy == "auto":
            self.algorithm = able[0]
            tiles = [x for x in able if x.startswith("block_gemm")]
            if self.config.complex_method == "3m" and tiles:
                self.algorithm = tiles[0]
            self.open = bool(tiles) and problem.macs >= COUNT_MACS and not self.config.strict_nonfinite and self.config.complex_method == "4m"
        else:
            want = self.config.strategy.split(".")[0]
            found = [x for x in able if x.split(".")[0] == want]
            if not found or "." in self.config.strategy and self.config.strategy not in found:
                raise E.StrategyRefused(f"{self.config.strategy} for this problem; it can be {able}")
            self.algorithm = found[0]
        if self.config.complex_method == "3m" and (not self.algorithm.startswith("block_gemm") or not problem.dtype.complex):
            raise E.StrategyRefused("3m is a method of complex tiles")

    def count(self, a: Tensor, b: Tensor) -> None:
        """Chooses between join and blocks by the rows that operands have, by join key: one aggregate over each side.

        If that leaves it open, one more over each side counts cells by block, which comes first, and may decide, where
        both sides are the same.
        Keys whose rows would make more than ``operators.HOT`` products in one task are found on the way.
        """
        p, c = self.problem, self.config
        from pyspark.sql import functions as F

        if X.mirrored(p, a, b) and self._count_mirrored(a, b):
            return
        counts = X.key_counts(p, a, b)
        n = F.col("na").cast("double") * F.col("nb")
        rows, na, nb, hot = counts.agg(F.sum(n), F.sum("na"), F.sum("nb"), F.count(F.when(n > X.HOT, 1))).first()
        edges = self._edges(a)
        rows = rows or 0.0
        join_cost = rows * JOINED + (na or 0) + (nb or 0)
        block_cost = (PACKED + SENT) * ((na or 0) + (nb or 0))
        if block_cost < join_cost:
            # Blocks that no cell reaches are not multiplied, and those where few cells meet take them one by one.
            blocks, sent = X.block_counts(p, a, b, edges).agg(F.sum(F.col("ba") * F.col("bb")), F.sum(F.col("na") * F.col("bb") + F.col("nb") * F.col("ba"))).first()
            block_cost += self._block_cost(edges, rows, blocks or 0, sent or 0)
        kind = "block_gemm" if block_cost < join_cost else "join_agg"
        self.algorithm = f"{kind}.{p.dtype.value}"
        self.counted = _Counted(self.algorithm, int(rows), join_cost, block_cost, counts.where(n > X.HOT) if hot and kind == "join_agg" else None, int(hot))

    def _edges(self, a: Tensor) -> tuple[int, int]:
        return X.edges_of(self.problem, self.config.block_size, self.config.partitions or 4 * a.df.sparkSession.sparkContext.defaultParallelism)

    def _block_cost(self, edges: tuple[int, int], rows: float, blocks: int, sent: int) -> float:
        """Of blocks that meet and cells sent to them, besides packing."""
        p = self.problem
        m, n, k = (min(e, max(1, p.size(x))) for x, e in ((p.m, edges[0]), (p.n, edges[0]), (p.k, edges[1])))
        met = blocks * MULTIPLIED * m * n * k * p.dtype.flops / 2
        met = min(met, rows * SINGLE) if self.catalog.tiles["4m"] is X.multiply else met
        return blocks * CALLED + met + SENT * sent

    def _count_mirrored(self, a: Tensor, b: Tensor) -> bool:
        """Chooses blocks by the cells of blocks alone, if these prove them the cheaper: both sides have the same rows by
        key, so n rows of a block's keys make n * n / keys products at least, and each product more favours blocks."""
        from pyspark.sql import functions as F

        edges = self._edges(a)
        n = F.col("na").cast("double")
        rows, cells, listed, blocks, sent = X.block_counts(self.problem, a, b, edges).agg(F.sum(n * n), F.sum("na"), F.sum("ba"), F.sum(F.col("ba") * F.col("bb")), F.sum(F.col("na") * F.col("bb") + F.col("nb") * F.col("ba"))).first()
        if not cells:
            return False
        rows /= min(edges[1], max(1, self.problem.size(self.problem.k)))
        join_cost, block_cost = rows * JOINED + 2 * cells, (PACKED + SENT) * 2 * cells + self._block_cost(edges, rows, blocks, sent)
        if block_cost >= join_cost:
            return False
        self.algorithm = f"block_gemm.{self.problem.dtype.value}"
        self.counted = _Counted(self.algorithm, int(rows), join_cost, block_cost, listed=listed)
        return True

    @property
    def report(self) -> PlanReport:
        p = self.problem
        rewrites = []
        if (p.alone_a or p.alone_b) and not self.config.strict_nonfinite:
            rewrites.append("isolated labels summed before the join")
        if any(x == 1 for _, x in p.extents):
            rewrites.append("unit extents dropped")
        rewrites.append("labels folded into linear keys")
        if any(len(set(x)) != len(x) for x in (p.labels.a, p.labels.b)):
            rewrites.append("diagonals filtered at the scan")
        if not p.k and not p.all_batch:
            rewrites.append("no aggregate: outer product")
        if p.all_batch:
            rewrites.append("no aggregate: elementwise")
        alone = p.size(p.alone_a) * p.size(p.alone_b)
        c = self.counted
        counted = (c.join_rows, c.join_cost, c.block_cost, c.hot_keys) if c else ()
        return PlanReport(self.algorithm, p.size(p.m), p.size(p.n), p.size(p.k) * alone, p.size(p.h), p.macs, p.macs * p.dtype.flops, p.size(p.output_labels), self.config.partitions, self.algorithm.startswith("block_gemm"), tuple(rewrites), *counted)

    # --- execution

    def _bind(self, t: Tensor, spec: OperandSpec, name: str) -> None:
        if t.dims != spec.dims:
            raise E.Mismatch(f"{name} is {t.dims}, planned {spec.dims}")
        if t.dtype != self.problem.dtype:
            raise E.DtypeMismatch(f"{name} is {t.dtype.value}, planned {self.problem.dtype.value}")

    def _products(self, a: Tensor, b: Tensor, least: float | None, grid_too: bool):
        """(o, re, im), and whether every element of the output has a row."""
        p, c = self.problem, self.config
        if self.open:
            self.count(a, b)
        kind, full = self.algorithm.split(".")[0], a.dense and b.dense
        if kind == "elementwise":
            return X.elementwise(p, a, b, c.orient, c.partitions), full
        if kind == "block_gemm":
            grid_too = grid_too and not full
            return X.block_gemm(p, a, b, c.block_size, self.catalog.tiles[c.complex_method], c.deterministic, full or grid_too, c.partitions, least, grid_too, listed=self.counted.listed if self.counted else None), full or grid_too
        return X.join_agg(p, a, b, c.orient, c.deterministic, c.strict_nonfinite, c.partitions, self.counted.hot if self.counted else None), full

    def _added(self, alpha: complex, a: Tensor, b: Tensor, beta: complex, old: Tensor, labels: Sequence[int]):
        """alpha * op(A) op(B) + beta * op(C) of blocks that begin with beta / alpha * op(C), if this is exact and made in
        one task a block; otherwise None, and results are joined."""
        p, c = self.problem, self.config
        if self.open:
            self.count(a, b)
            self.open = False
        if not self.algorithm.startswith("block_gemm") or c.deterministic or p.output_diagonal or alpha not in (1, -1, 2, -2, 0.5, -0.5):
            return None
        added = X.old_cells(p, old, labels, beta / alpha)
        rows = X.block_gemm(p, a, b, c.block_size, self.catalog.tiles[c.complex_method], False, False, c.partitions, added=added)
        return rows if rows is None else X.times(p, rows, alpha)

    def _made(self, a: Tensor, b: Tensor, old: Tensor, labels: Sequence[int]) -> Made | None:
        """How C was made, if it is a product of the same operands as A B, element by element; it need not be made twice."""
        p, c, made = self.problem, self.config, old.made
        if made is None or p.output_diagonal or c.density == "sparse" and old.dense:
            return None
        q = made.problem
        same = made.a is a and made.b is b and (q.labels.a, q.labels.b, q.labels.d) == (p.labels.a, p.labels.b, tuple(labels))
        same = same and set(labels) == set(p.labels.d) and (q.a.op, q.b.op, q.dtype, made.config.strict_nonfinite) == (p.a.op, p.b.op, p.dtype, c.strict_nonfinite)
        if same and self.open and made.counted and made.config == c and self.catalog.tiles["4m"] is X.multiply:
            self.counted, self.algorithm, self.open = made.counted, made.counted.algorithm, False
        return made if same else None

    def _run(self, alpha: complex, a: Tensor | None, b: Tensor | None, beta: complex, old: Tensor | None, labels: Sequence[int], in_place: bool) -> Tensor:
        p, least = self.problem, self.config.least
        if least is not None and p.dtype.complex:
            raise E.OptionError("least is for real types")
        if p.output_empty:
            out = X.complete(p, None, 0, 0, None, (), False)
            return out
        read = alpha != 0 and not p.contraction_empty
        if not read and in_place and beta == 1 and old is not None and p.c.op is Op.IDENTITY and p.d.op is Op.IDENTITY:
            return old
        use_old, sparse = old if beta != 0 else None, self.config.density == "sparse"
        made = self._made(a, b, use_old, labels) if read and use_old is not None else None
        if made is not None:
            rows, full = self._products(a, b, None, not sparse)
            out = X.complete(p, X.with_own_product(p, rows, alpha, beta, made), 1, 0, None, (), full, sparse)
            return out if least is None else out.replace(df=out.df.where(f"v >= {least}"), dense=False)
        if read and use_old is not None and sparse:
            rows = self._added(alpha, a, b, beta, use_old, labels)
            if rows is not None:
                out = X.complete(p, rows, 1, 0, None, (), False, True)
                return out if least is None else out.replace(df=out.df.where(f"v >= {least}"), dense=False)
        products, full = self._products(a, b, least if alpha == 1 and use_old is None else None, not sparse and use_old is None) if read else (None, False)
        out = X.complete(p, products, alpha, beta, use_old, labels, full, sparse)
        from pyspark.sql import functions as F

        return out if least is None else out.replace(df=out.df.where(F.col("v") >= least), dense=False)

    def execute(self, a: Tensor, b: Tensor, alpha: complex = 1, d_old: Tensor | None = None) -> Tensor:
        """Overwrites: alpha * op(A) op(B). ``d_old``: what elements off a repeated label's diagonal keep."""
        self._bind(a, self.problem.a, "A")
        self._bind(b, self.problem.b, "B")
        p = self.problem
        out = self._run(alpha, a, b, 0, None, (), False)
        if p.output_diagonal:
            return X.overlay(out, d_old) if d_old is not None else out
        # Single precision is rounded, and least leaves elements out: such a result isn't the product itself.
        whole = alpha != 0 and self.config.least is None and not p.dtype.single
        return out.replace(made=Made(p, a, b, alpha, self.config, self.counted if self.catalog.tiles["4m"] is X.multiply else None)) if whole else out

    def execute_accum(self, a: Tensor, b: Tensor, alpha: complex, beta: complex, c: Tensor | None = None, d_old: Tensor | None = None) -> Tensor:
        """Accumulates: ``d_old`` if C is D, ``c`` if it is separate. With beta 0 neither is read, and C may be None."""
        p = self.problem
        self._bind(a, p.a, "A")
        self._bind(b, p.b, "B")
        if p.c.kind == "output":
            if c is not None or d_old is None and beta != 0:
                raise E.CMode("planned to accumulate in D")
            if d_old is not None:
                self._bind(d_old, p.d, "D")
            out = self._run(alpha, a, b, beta, d_old, p.labels.d, True)
        elif p.c.kind == "separate":
            if c is None and beta != 0:
                raise E.CMode("planned with a separate C")
            if c is not None:
                self._bind(c, p.c.operand, "C")
            out = self._run(alpha, a, b, beta, c, p.labels.c, False)
        else:
            raise E.CMode("planned without C")
        return X.overlay(out, d_old) if p.output_diagonal and d_old is not None else out


def plan(problem: Problem, config: PlanConfig | None = None, **kw) -> Plan:
    return Plan(problem, config, **kw)


def contract(spec: str, a: Tensor, b: Tensor, alpha: complex = 1, conj: str = "", config: PlanConfig | None = None) -> Tensor:
    """One call for ``"ik,kj->ij"``."""
    return Plan(Problem.einsum(a.dtype, spec, a.dims, b.dims, conj), config).execute(a, b, alpha)


@dataclass(frozen=True)
class BatchItem:
    plan: Plan
    alpha: complex
    a: Tensor
    b: Tensor
    beta: complex = 0
    c: Tensor | None = None
    d_old: Tensor | None = None


def _checked(items: Sequence[BatchItem]) -> None:
    for i, x in enumerate(items):
        p = x.plan.problem
        kind = p.c.kind
        sides = [(x.a, p.a, "A"), (x.b, p.b, "B")]
        sides += [(x.c, p.c.operand, "C")] if kind == "separate" and x.c is not None else []
        sides += [(x.d_old, p.d, "D")] if x.d_old is not None else []
        try:
            for t, s, n in sides:
                x.plan._bind(t, s, n)
        except E.TensorError as e:
            raise type(e)(f"item {i}: {e}") from None
        if x.c is not None and kind != "separate":
            raise E.CMode(f"item {i}: planned without a separate C")
        if x.beta != 0 and (kind == "absent" or kind == "separate" and x.c is None or kind == "output" and x.d_old is None):
            raise E.CMode(f"item {i}: beta without its operand")


def _one(x: BatchItem) -> Tensor:
    return x.plan.execute_accum(x.a, x.b, x.alpha, x.beta, x.c, x.d_old) if x.beta != 0 else x.plan.execute(x.a, x.b, x.alpha, x.d_old)


def contract_batched(items: Sequence[BatchItem]) -> list[Tensor]:
    """Results in order. All operands of all items are validated before any is planned; a failure leaves nothing half done."""
    _checked(items)
    return [_one(x) for x in items]


def _stacked(tensors: Sequence[Tensor], factors: Sequence[complex]) -> Tensor:
    """One tensor with the item as its first axis, each item times its factor."""
    from functools import reduce

    from pyspark.sql import functions as F

    first = tensors[0]
    frames = []
    for i, (t, x) in enumerate(zip(tensors, factors, strict=True)):
        v = scaled(element(F.col("v"), t.dtype), x, t.dtype).pack(t.dtype).alias("v")
        frames.append(t.df.select(F.lit(i).cast("long").alias(axis(0)), *[F.col(axis(k)).alias(axis(k + 1)) for k in range(t.rank)], v))
    return Tensor(reduce(lambda x, y: x.unionByName(y), frames), (len(tensors), *first.dims), first.dtype, all(t.dense for t in tensors))


def _itemised(p: Problem, n: int) -> Problem:
    """The problem with the item as one more batch label, first everywhere."""
    label = max([0, *p.extent]) + 1

    def wide(s: OperandSpec) -> OperandSpec:
        return OperandSpec.of((n, *s.dims), s.op)

    c = CSpec.separate(wide(p.c.operand)) if p.c.kind == "separate" else p.c
    of_c = (label, *p.labels.c) if p.labels.c is not None else None
    return Problem.from_labels(p.dtype, wide(p.a), wide(p.b), c, wide(p.d), Labels((label, *p.labels.a), (label, *p.labels.b), (label, *p.labels.d), of_c))


def batched_frame(items: Sequence[BatchItem]):
    """One DataFrame of all results with an ``item`` column.

    Items of one plan run as one contraction, with the item as one more batch label and their factors folded into their
    operands, however many they are. Items that must not read their operands (alpha 0), and those of output diagonals,
    run by themselves.
    """
    from pyspark.sql import functions as F

    _checked(items)
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(items):
        alone = x.alpha == 0 or x.plan.problem.output_diagonal or x.plan.problem.contraction_empty or x.plan.problem.output_empty
        groups.setdefault((id(x.plan), x.beta != 0, i if alone else -1), []).append(i)
    out = None
    for (_, accumulates, alone), numbers in groups.items():
        first, chosen = items[numbers[0]], [items[i] for i in numbers]
        p = first.plan.problem
        if alone >= 0 or len(numbers) == 1:
            t = _one(first)
            rows = t.df.select(F.lit(numbers[0]).alias("item"), *[axis(k) for k in range(t.rank)], "v")
        else:
            wide = Plan(_itemised(p, len(chosen)), first.plan.config, catalog=first.plan.catalog)
            # op_D(alpha * op_A(A) ..): alpha goes into A under op_A.
            a = _stacked([x.a for x in chosen], [complex(x.alpha).conjugate() if p.a.op is Op.CONJUGATE else x.alpha for x in chosen])
            b = _stacked([x.b for x in chosen], [1] * len(chosen))
            if accumulates:
                old = _stacked([x.c if p.c.kind == "separate" else x.d_old for x in chosen], [complex(x.beta).conjugate() if p.c.op is Op.CONJUGATE else x.beta for x in chosen])
                t = wide.execute_accum(a, b, 1, 1, **({"c": old} if p.c.kind == "separate" else {"d_old": old}))
            else:
                t = wide.execute(a, b)
            number = F.get(F.array(*[F.lit(i) for i in numbers]), F.col(axis(0)).cast("int"))
            rows = t.df.select(number.alias("item"), *[F.col(axis(k + 1)).alias(axis(k)) for k in range(t.rank - 1)], "v")
        out = rows if out is None else out.unionByName(rows)
    return out


def execute_batched(plan_: Plan, a: Sequence[Tensor], b: Sequence[Tensor], alpha: complex = 1, beta: complex = 0, c: Sequence[Tensor] | None = None) -> list[Tensor]:
    """One plan and one pair of factors over many operands; C may be absent exactly if beta is 0."""
    if len(a) != len(b) or c is not None and len(c) != len(a):
        raise E.ConfigError("operand lists differ in length")
    if beta != 0 and c is None:
        raise E.CMode("beta needs C")
    sep = plan_.problem.c.kind == "separate"
    return contract_batched([BatchItem(plan_, alpha, x, y, beta, c[i] if c and sep else None, c[i] if c and not sep else None) for i, (x, y) in enumerate(zip(a, b, strict=True))])


# --- backends


@dataclass(frozen=True)
class Requirements:
    dtypes: tuple[DType, ...] = tuple(DType)
    no_materialize: bool = False


class PreparedContraction(ABC):
    @property
    @abstractmethod
    def diagnostics(self) -> Diagnostics: ...

    @abstractmethod
    def run(self, a: Tensor, b: Tensor, alpha: complex = 1, beta: complex = 0, c: Tensor | None = None) -> Tensor: ...


class ContractionBackend(ABC):
    """Anything that can prepare a problem and run it on tensors."""

    name = "backend"

    @abstractmethod
    def prepare(self, problem: Problem, requirements: Requirements | None = None, budget: PlanningBudget | None = None) -> PreparedContraction: ...


@dataclass(frozen=True)
class _SparkPrepared(PreparedContraction):
    plan: Plan

    @property
    def diagnostics(self):
        copies = self.plan.algorithm.startswith("block_gemm")
        return Diagnostics("spark", self.plan.algorithm, (copies, copies, False))

    def run(self, a, b, alpha=1, beta=0, c=None):
        if beta == 0:
            return self.plan.execute(a, b, alpha)
        return self.plan.execute_accum(a, b, alpha, beta, **({"c": c} if self.plan.problem.c.kind == "separate" else {"d_old": c}))


class SparkBackend(ContractionBackend):
    name = "spark"

    def __init__(self, config: PlanConfig | None = None):
        self.config = config

    def prepare(self, problem, requirements=None, budget=None):
        config = self.config or PlanConfig()
        if requirements:
            if problem.dtype not in requirements.dtypes:
                raise E.DatatypeUnsupported(problem.dtype.value)
            config = replace(config, no_materialize=config.no_materialize or requirements.no_materialize)
        if budget and config.partitions is None:
            config = replace(config, partitions=budget.partitions())
        return _SparkPrepared(Plan(problem, config))


@dataclass(frozen=True)
class _NumpyPrepared(PreparedContraction):
    problem: Problem

    @property
    def diagnostics(self):
        return Diagnostics("numpy", "einsum", (True, True, self.problem.c.kind != "absent"))

    def run(self, a, b, alpha=1, beta=0, c=None):
        import numpy as np
        from sparkfold.sources import from_numpy, to_numpy

        p = self.problem
        ids = {x: i for i, x in enumerate(p.extent)}
        out = list(p.output_labels)
        conj = lambda x, op: np.conj(x) if op is Op.CONJUGATE else x
        total = np.zeros([p.extent[x] for x in out], complex if p.dtype.complex else float)
        if alpha != 0 and not p.contraction_empty:
            total = alpha * np.einsum(conj(to_numpy(a), p.a.op), [ids[x] for x in p.labels.a], conj(to_numpy(b), p.b.op), [ids[x] for x in p.labels.b], [ids[x] for x in out])
        if beta != 0:
            labels = p.labels.c if p.c.kind == "separate" else p.labels.d
            total = total + beta * np.einsum(conj(to_numpy(c), p.c.op), [ids[x] for x in labels], [ids[x] for x in out])
        total = conj(total, p.d.op)
        if p.output_diagonal:
            full = np.zeros([p.extent[x] for x in p.labels.d], total.dtype)
            at = np.indices(total.shape)
            full[tuple(at[out.index(x)] for x in p.labels.d)] = total
            total = full
        return from_numpy(a.df.sparkSession, np.asarray(total), p.dtype)


class NumpyBackend(ContractionBackend):
    """A second, independent backend on the driver, for small tensors."""

    name = "numpy"

    def prepare(self, problem, requirements=None, budget=None):
        if requirements:
            if problem.dtype not in requirements.dtypes:
                raise E.DatatypeUnsupported(problem.dtype.value)
            if requirements.no_materialize:
                raise E.WouldMaterialize("the driver's backend copies its operands")
        return _NumpyPrepared(problem)


__all__ = ["BatchItem", "CSpec", "ContractionBackend", "Diagnostics", "Labels", "NumpyBackend", "Plan", "PlanConfig", "PlanReport", "PlanningBudget", "PreparedContraction", "Requirements", "SparkBackend", "TileCatalog", "batched_frame", "candidates", "contract", "contract_batched", "execute_batched", "list_strategies", "plan"]
