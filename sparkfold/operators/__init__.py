"""Physical forms of a contraction, all built from linear BIGINT keys.

Labels of a role fold into one key: the shared labels into the join key ``j``, D's labels into the output key ``o``
(row-major position), so that a shuffle moves two keys and a value whatever the rank. Extents of 1 drop out by
themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfold.functions import Num, element, scaled
from sparkfold.meta import DType, LayoutSpec, Op, product
from sparkfold.problem import Problem
from sparkfold.sources import Made, Tensor, axis, coordinate, grid

#: A side is broadcast on request or by rule only if its extents bound it to this many bytes.
BROADCAST_BYTES = 32 << 20


def linear(labels: Sequence[int], extent: dict[int, int], at: dict[int, Column], within: Sequence[int] | None = None) -> Column:
    """Row-major position over ``within`` of the given labels' coordinates."""
    within = list(within if within is not None else labels)
    strides = dict(zip(within, LayoutSpec.row_major([extent[x] for x in within]).strides, strict=True))
    out = F.lit(0).cast("long")
    for x in labels:
        if extent[x] != 1:
            out = out + (at[x] if strides[x] == 1 else at[x] * F.lit(strides[x]).cast("long"))
    return out


def labelled(t: Tensor, labels: Sequence[int], op: Op) -> tuple[DataFrame, dict[int, Column]]:
    """The tensor's rows on the diagonals its labels ask for, as columns ``l<i>`` by distinct label and re, im."""
    distinct = list(dict.fromkeys(labels))
    df = t.df
    for i, x in enumerate(labels):
        first = labels.index(x)
        if first != i:
            df = df.where(F.col(axis(first)) == F.col(axis(i)))
    v = element(F.col("v"), t.dtype)
    v = v.conj() if op is Op.CONJUGATE else v
    cols = [F.col(axis(labels.index(x))).alias(f"l{i}") for i, x in enumerate(distinct)]
    cols += [v.re.alias("re")] + ([v.im.alias("im")] if v.im is not None else [])
    return df.select(*cols), {x: F.col(f"l{i}") for i, x in enumerate(distinct)}


def num(dtype: DType, prefix: str = "") -> Num:
    return Num(F.col(prefix + "re"), F.col(prefix + "im") if dtype.complex else None)


def operands(p: Problem, a: Tensor, b: Tensor, reduce_alone: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides as (j, o, re, im) with prefixes a and b. Unless isolated labels are summed here, their position is x."""
    shared, out = [*p.h, *p.k], p.output_labels
    own_b = [x for x in out if x not in p.labels.a]
    own_a = [x for x in out if x in p.labels.a]
    strides = dict(zip(out, LayoutSpec.row_major([p.extent[x] for x in out]).strides, strict=True))

    def keys(t, labels, op, mine, alone, prefix):
        rows, at = labelled(t, labels, op)
        o = F.lit(0).cast("long")
        for x in mine:
            if p.extent[x] != 1:
                o = o + at[x] * F.lit(strides[x]).cast("long")
        parts = ("re", "im")[: 1 + p.dtype.complex]
        own = linear(alone, p.extent, at) if not reduce_alone else F.lit(0).cast("long")
        rows = rows.select(linear(shared, p.extent, at).alias("j"), o.alias("o"), own.alias("x"), *[F.col(c) for c in parts])
        if alone and reduce_alone:
            rows = rows.groupBy("j", "o", "x").agg(*[F.sum(c).alias(c) for c in parts])
        return rows.select(*[F.col(c).alias(prefix + c) for c in ("j", "o", *(() if reduce_alone else ("x",)), *parts)])

    return keys(a, p.labels.a, p.a.op, own_a, p.alone_a, "a"), keys(b, p.labels.b, p.b.op, own_b, p.alone_b, "b")


def _bytes(dims: Sequence[int], dtype: DType) -> int:
    return product(dims) * (8 * len(dims) + (16 if dtype.complex else 8))


#: Rows of one key that meet one another in a task; keys with more are split on both sides.
MEET = 4096
#: Products of one key from which it is split.
HOT = MEET * MEET


def key_counts(p: Problem, a: Tensor, b: Tensor, reduce_alone: bool = True) -> DataFrame:
    """(j, na, nb): rows of both sides by join key, of keys that both have. Rows of a coordinate that aren't summed yet
    count one by one, which saves a shuffle, unless isolated labels are summed before the join."""
    shared = [*p.h, *p.k]

    def keys(t, labels, op, prefix, alone, side):
        if alone and reduce_alone:
            return operands(p, a, b)[side].select(F.col(prefix + "j").alias("j"))
        rows, at = labelled(t.unsummed(), labels, op)
        return rows.select(linear(shared, p.extent, at).alias("j"))

    na, nb = (
        keys(*x).groupBy("j").agg(F.count("*").alias(n))
        for n, x in (("na", (a, p.labels.a, p.a.op, "a", p.alone_a, 0)), ("nb", (b, p.labels.b, p.b.op, "b", p.alone_b, 1)))
    )
    return na.join(nb, "j")


def block_counts(p: Problem, a: Tensor, b: Tensor, edges: tuple[int, int]) -> DataFrame:
    """(ba, bb, na, nb): blocks and cells of both sides by batch and part of the contraction that both have."""

    def side(t, labels, op, role, x):
        rows, at = labelled(t.unsummed(), labels, op)
        rows = rows.select(linear(p.h, p.extent, at).alias("h"), linear(role, p.extent, at).alias("r"), linear(p.k, p.extent, at).alias("k"))
        cells = rows.groupBy("h", F.expr(f"k div {edges[1]}L").alias("kb"), F.expr(f"r div {edges[0]}L").alias("rb")).agg(F.count("*").alias("n"))
        return cells.groupBy("h", "kb").agg(F.count("*").alias("b" + x), F.sum("n").alias("n" + x))

    return side(a, p.labels.a, p.a.op, p.m, "a").join(side(b, p.labels.b, p.b.op, p.n, "b"), ["h", "kb"])


def mirrored(p: Problem, a: Tensor, b: Tensor) -> bool:
    """Whether B is A with another label for each of A's own: D's element (m, n) is then that of (n, m)."""
    if a is not b or p.a.op != p.b.op or p.alone_a or p.alone_b:
        return False
    other: dict[int, int] = {}
    for x, y in zip(p.labels.a, p.labels.b, strict=True):
        if not (x == y and x in (*p.h, *p.k) or x in p.m and y in p.n and other.setdefault(x, y) == y):
            return False
    return [other[x] for x in p.m] == list(p.n)


def split_hot(a: DataFrame, b: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gives rows of hot keys a part of their own side and copies for the parts of the other: no two rows meet twice,
    and no task gets more than about ``MEET`` rows of a side of one key."""
    parts = hot.select(F.col("j").alias("hj"), F.ceil(F.col("na") / MEET).cast("int").alias("sa"), F.ceil(F.col("nb") / MEET).cast("int").alias("sb"))

    def cut(df: DataFrame, x: str, own: str, other: str) -> DataFrame:
        one = F.coalesce(F.col(own), F.lit(1))
        out = df.join(parts, F.col(x + "j") == F.col("hj"), "left").withColumn("_own", F.pmod(F.xxhash64(*df.columns), one).cast("int"))
        out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        pair = ("_own", "_other") if x == "a" else ("_other", "_own")
        return out.select(*df.columns, F.col(pair[0]).alias(x + "p"), F.col(pair[1]).alias(x + "q"))

    return cut(a, "a", "sa", "sb"), cut(b, "b", "sb", "sa")


def paired(p: Problem, a: DataFrame, b: DataFrame, orient: str, partitions: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The join of both sides; ``orient`` ab builds on b, ba on a, rule leaves it to Catalyst. ``partitions``: into how
    many the work is dealt. ``hot``: (j, na, nb) of keys to split."""
    if not (p.h or p.k):
        a = a.repartition(partitions) if partitions else a
        return a.drop("aj").crossJoin(b.drop("bj"))
    on = ["j"]
    if hot is not None:
        (a, b), on = split_hot(a, b, hot), ["j", "p", "q"]
    # A repeated label counts once: only the diagonal is sent.
    small_b, small_a = (orient == side and _bytes([p.extent[x] for x in dict.fromkeys(labels)], p.dtype) <= BROADCAST_BYTES for side, labels in (("ab", p.labels.b), ("ba", p.labels.a)))
    if partitions:
        a = a if small_a else a.repartition(partitions, *["a" + x for x in on])
        b = b if small_b else b.repartition(partitions, *["b" + x for x in on])
    a, b = F.broadcast(a) if small_a else a, F.broadcast(b) if small_b else b
    same = F.col("aj") == F.col("bj")
    for x in on[1:]:
        same = same & (F.col("a" + x) == F.col("b" + x))
    return a.join(b, same).drop(*["b" + x for x in on], "ap", "aq")


def join_agg(p: Problem, a: Tensor, b: Tensor, orient: str = "rule", deterministic: bool = False, strict: bool = False, partitions: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """(o, re, im): equi-join on the shared labels, then one sum per output element."""
    left, right = operands(p, a, b, reduce_alone=not strict)
    joined = paired(p, left, right, orient, partitions, hot)
    x = num(p.dtype, "a") * num(p.dtype, "b")
    j = F.col("aj") if p.h or p.k else F.lit(0).cast("long")
    parts = [x.re.alias("re")] + ([x.im.alias("im")] if x.im is not None else [])
    alone = strict and (p.alone_a or p.alone_b)
    if alone:
        j = (j * F.lit(p.size(p.alone_a)) + F.col("ax")) * F.lit(p.size(p.alone_b)) + F.col("bx")
    terms = joined.select((F.col("ao") + F.col("bo")).alias("o"), j.alias("j"), *parts)
    positions = p.size([*p.h, *p.k]) * (p.size([*p.alone_a, *p.alone_b]) if alone else 1)
    return summed(terms, p.dtype, deterministic, positions) if p.k or alone else terms.drop("j")


def _running(part: str) -> Column:
    return F.aggregate("t", F.lit(0.0), lambda s, x: s + x[part])


#: Terms of an ordered partial sum, at most.
ORDERED = 1024


def summed(terms: DataFrame, dtype: DType, deterministic: bool, positions: int) -> DataFrame:
    """(o, re, im) from (o, j, re, im), 0 <= j < ``positions``."""
    parts = ("re", "im")[: 1 + dtype.complex]
    if not deterministic:
        return terms.groupBy("o").agg(*[F.sum(c).alias(c) for c in parts])
    # Partial sums of fixed ranges of j, in the order of j, then of ranges of ranges: the same bits under any
    # partitioning, and no list longer than ORDERED.
    while True:
        bucket = F.expr(f"j div {ORDERED}L") if positions > ORDERED else F.lit(0).cast("long")
        ordered = terms.withColumn("b", bucket).groupBy("o", "b").agg(F.array_sort(F.collect_list(F.struct("j", *parts))).alias("t"))
        total = [_running(c).alias(c) for c in parts]
        if positions <= ORDERED:
            return ordered.select("o", *total)
        terms, positions = ordered.select("o", F.col("b").alias("j"), *total), -(-positions // ORDERED)


def elementwise(p: Problem, a: Tensor, b: Tensor, orient: str = "rule", partitions: int | None = None) -> DataFrame:
    """(o, re, im) of a problem with batch labels only: a join and a product, no aggregate."""
    left, right = operands(p, a, b)
    joined = paired(p, left, right, orient, partitions)
    x = num(p.dtype, "a") * num(p.dtype, "b")
    return joined.select((F.col("ao") + F.col("bo")).alias("o"), x.re.alias("re"), *([x.im.alias("im")] if x.im is not None else []))


TileFunction = Callable[..., object]


def multiply(a, b):
    return a @ b


def multiply_3m(a, b):
    """Complex product by three real ones; its error bound is weaker."""
    x, y = a.real @ b.real, a.imag @ b.imag
    return (x - y) + 1j * ((a.real + a.imag) @ (b.real + b.imag) - x - y)


#: Edge of blocks along the contraction, and of output blocks that are held while terms come, at most.
EDGE, HELD = 512, 2048
#: Elements of a side's block, and its edge, where the whole contraction is one block and output is given as it is made.
SIDE, WIDE = 1 << 22, 1 << 14
#: Cells of a packed piece of a block, and cells that a task gathers before it packs them.
PIECE, GATHERED = 1024, 1 << 20
#: Entries of the list of the other side's blocks up to which it is broadcast.
LISTED = 1 << 20


def edges_of(p: Problem, size: int | None, tasks: int) -> tuple[int, int]:
    """Edges of a block along the output and along the contraction. Left to the plan (``size`` None), output blocks are
    as large as memory allows, since a cell is sent once for each of the other side's, but ``tasks`` of them at least."""
    if size is not None:
        return size, size
    k = min(EDGE, max(1, p.size(p.k)))
    edge = EDGE
    most = min(WIDE, SIDE // k) if p.size(p.k) <= k else HELD
    while 2 * edge <= most and p.size(p.h) * -(-p.size(p.m) // (2 * edge)) * -(-p.size(p.n) // (2 * edge)) >= tasks:
        edge *= 2
    return edge, k


def blocks_of(p: Problem, edges: tuple[int, int]) -> tuple[int, int, int]:
    """Blocks of the output's rows, its columns and the contraction."""
    return tuple(max(1, -(-p.size(x) // size)) for x, size in ((p.m, edges[0]), (p.n, edges[0]), (p.k, edges[1])))


def packed(r, k, v) -> bytes:
    """Cells of a block: differences of the sorted coordinates and the values by bytes of equal weight, compressed."""
    import zlib

    import numpy as np

    order = np.lexsort((k, r))
    places = np.diff(np.stack([r[order], k[order]]).astype(np.uint32), axis=1, prepend=np.zeros((2, 1), np.uint32))
    raw = [x.view(np.uint8).reshape(-1, n).T.tobytes() for x, n in ((places[0].copy(), 4), (places[1].copy(), 4), (v[order], 8 * v.itemsize // 8))]
    return zlib.compress(b"".join(raw), 1)


def unpacked(piece: bytes, kind: str):
    import zlib

    import numpy as np

    raw, size = np.frombuffer(zlib.decompress(piece), np.uint8), np.dtype(kind).itemsize
    n = len(raw) // (8 + size)
    r, k = (np.cumsum(raw[4 * n * i : 4 * n * (i + 1)].reshape(4, n).T.copy().view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64) for i in (0, 1))
    return r, k, raw[8 * n :].reshape(size, n).T.copy().view(kind).ravel()


def _pieces(cells: DataFrame, edges: tuple[int, int], dtype: DType) -> DataFrame:
    """(h, b, kb, piece) from (h, r, k, re, im): the cells of each block, packed where they are."""
    kind = "complex128" if dtype.complex else "float64"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def give():
            h, r, k, *v = (np.concatenate([x[i] for x in held]) for i in range(len(held[0])))
            v = np.ascontiguousarray(v[0] + 1j * v[1] if dtype.complex else v[0], kind)
            b, kb = r // edges[0], k // edges[1]
            order = np.lexsort((kb, b, h))
            h, b, kb, r, k, v = (x[order] for x in (h, b, kb, r % edges[0], k % edges[1], v))
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (b[1:] != b[:-1]) | (kb[1:] != kb[:-1])])
            cuts = [(i, min(i + PIECE, stop)) for start, stop in zip(new, [*new[1:], len(h)], strict=True) for i in range(start, stop, PIECE)]
            for c in range(0, len(cuts), 256):
                now = cuts[c : c + 256]
                at = np.array([i for i, _ in now])
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(b[at]), pa.array(kb[at]), pa.array([packed(r[i:j], k[i:j], v[i:j]) for i, j in now], pa.binary())], ["h", "b", "kb", "piece"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch[i].to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
                n += batch.num_rows
            if n >= GATHERED:
                yield from give()
                held, n = [], 0
        if n:
            yield from give()

    return cells.mapInArrow(run, "h long, b long, kb long, piece binary")


def _expanded(a: tuple, b: tuple, step: int = 1 << 18):
    """(row, column, product) of the cells of both sides that share a position of the contraction, some at a time."""
    import numpy as np

    order = np.argsort(b[1], kind="stable")
    rb, kb, vb = (x[order] for x in b)
    first, last = np.searchsorted(kb, a[1], "left"), np.searchsorted(kb, a[1], "right")
    ends = np.cumsum(last - first)
    i = 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + step, "right")))
        n = (last - first)[i:j]
        of = np.repeat(np.arange(i, j), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j], n)
        yield a[0][of], rb[at], a[2][of] * vb[at]
        i = j


#: Dense multiply-adds that take as long as one product of two single cells.
SPARSE = 200


def block_gemm(
    p: Problem,
    a: Tensor,
    b: Tensor,
    size: int | None = None,
    tile: TileFunction = multiply,
    deterministic: bool = False,
    every_cell: bool = False,
    partitions: int | None = None,
    least: float | None = None,
    grid_too: bool = False,
    added: DataFrame | None = None,
    listed: int | None = None,
) -> DataFrame | None:
    """(o, re, im) by blocks of the output, each made in one task.

    Cells are packed by block where they are read, and a packed piece goes to the output blocks (of its row of blocks or
    its column of blocks) for which the other side has cells of the same part of the contraction. A task reads its pieces
    in the order of output block and contraction block, multiplies a contraction block's two sides (dense over the rows
    and positions that have cells; cell by cell where these are few) and adds the product to the output block it is at,
    which it gives out when the next one begins. Where the contraction is one block, output rows are given out as they
    are made. So nothing of the size of the output is sent between tasks. Only where there are too few output blocks for
    the tasks, or sums must be in order, do several tasks share an output block, and Spark adds their parts.
    Elements of value 0 are left out unless ``every_cell``; ``grid_too`` gives the blocks too that no cell reaches.
    Where B is A with other labels and the contraction has several blocks, an output block and its mirror image are made
    at once, of pieces of one side; ``listed`` is then the number of a side's blocks, if known. ``least``: elements below it are left out. ``added``: (o, re, im) of unique o that blocks begin with; None comes back
    where an output block isn't made in one task, since sums of several would add it more than once.
    """
    dtype = p.dtype
    parts = ("re", "im")[: 1 + dtype.complex]
    strides = dict(zip(p.output_labels, LayoutSpec.row_major([p.extent[x] for x in p.output_labels]).strides, strict=True))
    tasks = partitions or 4 * a.df.sparkSession.sparkContext.defaultParallelism
    edges = edges_of(p, size, tasks)
    edge, k_edge = edges
    m_blocks, n_blocks, k_blocks = blocks_of(p, edges)
    rows_m, rows_n, rows_k = p.size(p.m), p.size(p.n), p.size(p.k)
    outputs = p.size(p.h) * m_blocks * n_blocks
    # Contraction blocks that a task takes of an output block.
    shares = 1 if outputs >= tasks and not deterministic else min(k_blocks, -(-tasks // outputs))
    run_of = -(-k_blocks // shares) if not deterministic else 1
    shares = -(-k_blocks // run_of)
    alone_in_task = shares == 1 and not deterministic
    if added is not None and not alone_in_task:
        return None

    # One side's cells are sent, to half of the output's blocks.
    mirror = alone_in_task and added is None and k_blocks > 1 and tile in (multiply, multiply_3m) and mirrored(p, a, b)

    def cells(t, labels, op, role, alone):
        # Cells of a coordinate are added up in the block; in order, they must be summed before.
        rows, at = labelled(t if deterministic else t.unsummed(), labels, op)
        rows = rows.select(linear(p.h, p.extent, at).alias("h"), linear(role, p.extent, at).alias("r"), linear(p.k, p.extent, at).alias("k"), *parts)
        return rows.groupBy("h", "r", "k").agg(*[F.sum(c).alias(c) for c in parts]) if alone else rows

    def sent(own, others, first, n_others):
        rows = _pieces(own, edges, dtype)
        if n_others == 1:
            rows = rows.withColumn("other", F.lit(0).cast("long"))
        else:
            lists = others.select(F.col("h").alias("lh"), F.expr(f"k div {k_edge}L").alias("lk"), F.expr(f"r div {edge}L").alias("other")).distinct().groupBy("lh", "lk").agg(F.collect_set("other").alias("others"))
            lists = F.broadcast(lists) if (listed if mirror and listed is not None else p.size(p.h) * k_blocks * n_others) <= LISTED else lists
            rows = rows.join(lists, (F.col("h") == F.col("lh")) & (F.col("kb") == F.col("lk"))).withColumn("other", F.explode("others"))
        m, n = (F.col("b"), F.col("other")) if first else (F.col("other"), F.col("b"))
        side = F.lit(0 if first else 1)
        if mirror:
            side = F.when(m == n, 4).otherwise(F.when(m < n, 0).otherwise(1))
            m, n = F.least(m, n), F.greatest(m, n)
        return rows.select(((F.col("h") * m_blocks + m) * n_blocks + n).alias("block"), "kb", side.alias("side"), "piece")

    of_a, of_b = cells(a, p.labels.a, p.a.op, p.m, p.alone_a), cells(b, p.labels.b, p.b.op, p.n, p.alone_b)
    pieces = sent(of_a, of_b, True, n_blocks)
    pieces = pieces if mirror else pieces.unionByName(sent(of_b, of_a, False, m_blocks))
    if added is not None:
        at = {x: coordinate("o", strides[x], p.extent[x]) for x in p.output_labels}
        own = {n: linear(role, p.extent, at) for n, role in (("h", p.h), ("m", p.m), ("n", p.n))}
        # As cells of the blocks of D: r along its rows, k along its columns.
        held = _pieces(added.select((own["h"]).alias("h"), own["m"].alias("r"), own["n"].alias("k"), *parts), (edge, edge), dtype)
        held = held.select(((F.col("h") * m_blocks + F.col("b")) * n_blocks + F.col("kb")).alias("block"), F.lit(-1).cast("long").alias("kb"), F.lit(3).alias("side"), "piece")
        pieces = pieces.unionByName(held)
    if grid_too:
        every = a.df.sparkSession.range(outputs).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("kb"), F.lit(2).alias("side"), F.lit(b"").alias("piece"))
        every = every.where(f"block div {n_blocks}L % {m_blocks} <= block % {n_blocks}") if mirror else every
        pieces = pieces.unionByName(every)
    number = F.col("block")
    if mirror:
        # The blocks on and above the diagonal, counted by columns.
        number = F.expr(f"block div {n_blocks * n_blocks}L * {n_blocks * (n_blocks + 1) // 2} + (block % {n_blocks}) * (block % {n_blocks} + 1) div 2 + block div {n_blocks}L % {n_blocks}")
    place = number * shares + (F.expr(f"kb div {run_of}L") if shares > 1 else F.lit(0).cast("long"))
    dealt = min(outputs * shares, max(tasks, int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if not partitions else partitions
    pieces = pieces.repartitionById(dealt, F.pmod(place, F.lit(dealt)).cast("int")) if outputs * shares > 1 else pieces.coalesce(1)
    kind = "complex128" if dtype.complex else "float64"
    extent, labels = p.extent, (p.h, p.m, p.n)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def spread(at, own):
            """Places in the output of positions along one role's labels."""
            out, at = np.zeros(np.shape(at), np.int64), np.asarray(at, np.int64)
            for x, s in zip(own, LayoutSpec.row_major([extent[y] for y in own]).strides, strict=True):
                out = out + at // max(s, 1) % max(extent[x], 1) * strides[x]
            return out

        def both(block: int, kb: int, made):
            """An output block and, off the diagonal, its mirror image."""
            yield from give(block, kb, made)
            h, rest = divmod(block, m_blocks * n_blocks)
            m, n = divmod(rest, n_blocks)
            if mirror and m != n:
                yield from give((h * m_blocks + n) * n_blocks + m, kb, made.T)

        def give(block: int, kb: int, made, first: int = 0):
            """Rows of an output block from ``first`` on."""
            h, rest = divmod(block, m_blocks * n_blocks)
            m, n = (x * edge for x in divmod(rest, n_blocks))
            made = made[: max(0, rows_m - m - first), : rows_n - n]
            down = spread(np.arange(made.shape[0]) + m + first, labels[1]) + int(spread(h, labels[0]))
            across = spread(np.arange(made.shape[1]) + n, labels[2])
            step = max(1, (1 << 16) // max(1, made.shape[1]))
            for i in range(0, made.shape[0], step):
                v = np.ascontiguousarray(made[i : i + step]).ravel()
                o = (down[i : i + step, None] + across).ravel()
                if least is not None and alone_in_task:
                    keep = v >= least
                elif not every_cell:
                    keep = v != 0
                else:
                    keep = None
                if keep is not None and not keep.all():
                    keep = np.flatnonzero(keep)
                    o, v = o[keep], v[keep]
                if len(v):
                    cols = [o, v.real, v.imag] if dtype.complex else [o, v]
                    cols += [] if alone_in_task else [np.full(len(v), kb)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["o", *parts, *([] if alone_in_task else ["j"])])

        total, sides, at, seeded, start = None, ([], []), None, False, []

        def matched():
            """Both sides' cells at positions that both have, their rows, columns and positions, and whether few meet."""
            (ra, ka, va), (rb, kb, vb) = (tuple(np.concatenate(x) for x in zip(*s, strict=True)) for s in sides)
            na, nb = np.bincount(ka, minlength=k_edge), np.bincount(kb, minlength=k_edge)
            both = (na > 0) & (nb > 0)
            keep = both[ka], both[kb]
            one, two = ((ra[keep[0]], ka[keep[0]], va[keep[0]]), (rb[keep[1]], kb[keep[1]], vb[keep[1]]))
            us = np.unique(one[0]), np.unique(two[0]), np.flatnonzero(both)
            few = tile is multiply and float(na @ nb) * SPARSE < float(len(us[0])) * len(us[1]) * len(us[2])
            return one, two, us, few

        def filled(cells, rows, positions):
            out = np.zeros((len(rows), len(positions)), kind)
            np.add.at(out, (np.searchsorted(rows, cells[0]), np.searchsorted(positions, cells[1])), cells[2])
            return out

        def multiplied():
            nonlocal total
            if sides[0] and sides[1]:
                one, two, us, few = matched()
                if len(us[2]):
                    total = np.zeros((edge, edge), kind) if total is None else total
                    if few:
                        for r, c, x in _expanded(one, two):
                            np.add.at(total.reshape(-1), r * edge + c, x)
                    else:
                        got = tile(filled(one, us[0], us[2]), filled(two, us[1], us[2]).T)
                        if len(us[0]) == len(us[1]) == edge:
                            total += got
                        else:
                            total[np.ix_(us[0], us[1])] += got
            for s in sides:
                s.clear()

        def streamed():
            """The whole of an output block whose contraction is one block, some rows at a time."""
            none = not (sides[0] and sides[1])
            begun = tuple(np.concatenate(x) for x in zip(*start, strict=True)) if start else None
            start.clear()
            if none and not seeded and begun is None:
                return
            if begun is not None:
                order = np.argsort(begun[0], kind="stable")
                begun = tuple(x[order] for x in begun)
            one, two, us, few = (None, None, (np.zeros(0, np.int64),) * 3, False) if none else matched()
            right = None if none or few else filled(two, us[1], us[2]).T
            order = None if none else np.argsort(one[0], kind="stable")
            one = None if none else tuple(x[order] for x in one)
            step = max(1, min(edge, (1 << 21) // edge))
            for first in range(0, edge, step):
                low, high = (0, 0) if none else np.searchsorted(one[0], [first, first + step])
                old = (0, 0) if begun is None else np.searchsorted(begun[0], [first, first + step])
                if low == high and old[0] == old[1] and not (every_cell and (seeded or not none)):
                    continue
                made, here = np.zeros((step, edge), kind), () if none else tuple(x[low:high] for x in one)
                if low < high and few:
                    for r, c, x in _expanded(here, two):
                        np.add.at(made.reshape(-1), (r - first) * edge + c, x)
                elif low < high:
                    rows = np.unique(here[0])
                    made[np.ix_(rows - first, us[1])] = tile(filled(here, rows, us[2]), right)
                if old[0] < old[1]:
                    r, k, v = (x[old[0] : old[1]] for x in begun)
                    np.add.at(made, (r - first, k), v)
                yield from give(at[0], 0, made, first)

        def closed(last: bool):
            """What is to be given out at the end of a block."""
            nonlocal total, seeded
            if alone_in_task and k_blocks == 1:
                if last:
                    yield from streamed()
                    seeded = False
                    for s in sides:
                        s.clear()
                return
            multiplied()
            if deterministic or last:
                if total is None and seeded:
                    total = np.zeros((edge, edge), kind)
                if total is not None:
                    yield from both(*at, total)
                total, seeded = None, False

        for batch in batches:
            for block, kb, side, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and (block, kb) != at:
                    yield from closed(block != at[0])
                at = block, kb
                if side == 2:
                    seeded = True
                elif side == 3 and k_blocks == 1:
                    start.append(unpacked(piece, kind))
                elif side == 3:
                    r, k, v = unpacked(piece, kind)
                    total = np.zeros((edge, edge), kind) if total is None else total
                    np.add.at(total, (r, k), v)
                else:
                    for s in sides if side == 4 else (sides[side],):
                        s.append(unpacked(piece, kind))
        if at is not None:
            yield from closed(True)

    schema = "o long, re double" + (", im double" if dtype.complex else "") + ("" if alone_in_task else ", j long")
    terms = pieces.sortWithinPartitions("block", "kb", "side").mapInArrow(run, schema)
    return terms if alone_in_task else summed(terms, dtype, deterministic, k_blocks)


def old_cells(p: Problem, old: Tensor, labels: Sequence[int], beta: complex) -> DataFrame:
    """(o, re, im) of beta * op_C(old)."""
    held, at = labelled(old, labels, p.c.op)
    y = scaled(num(p.dtype), beta, p.dtype)
    return held.select(linear(p.output_labels, p.extent, at).alias("o"), y.re.alias("re"), *([y.im.alias("im")] if y.im is not None else []))


def times(p: Problem, rows: DataFrame, alpha: complex) -> DataFrame:
    x = scaled(num(p.dtype), alpha, p.dtype)
    return rows.select("o", x.re.alias("re"), *([x.im.alias("im")] if x.im is not None else []))


def with_own_product(p: Problem, rows: DataFrame, alpha: complex, beta: complex, made: Made) -> DataFrame:
    """(o, re, im) of alpha * x + beta * op_C(C) where C is made of the same x, the products in ``rows``."""
    old = scaled(num(p.dtype), made.alpha, p.dtype)
    for op in (made.problem.d.op, p.c.op):
        old = old.conj() if op is Op.CONJUGATE else old
    x = scaled(num(p.dtype), alpha, p.dtype) + scaled(old, beta, p.dtype)
    return rows.select("o", x.re.alias("re"), *([x.im.alias("im")] if x.im is not None else []))


def complete(p: Problem, products: DataFrame | None, alpha: complex, beta: complex, old: Tensor | None, old_labels: Sequence[int], always_full: bool, sparse: bool = False) -> Tensor:
    """op_D(alpha * products + beta * op_C(old)) over D's whole grid.

    ``products`` None: they are not to be read (alpha 0 or nothing to contract). ``old`` None: beta's operand is not to
    be read. ``always_full``: every output element has a product. ``sparse``: elements without a term stay absent.
    """
    dtype, out = p.dtype, p.output_labels
    dims = [p.extent[x] for x in out]
    rows = None
    if products is not None:
        x = scaled(num(dtype), alpha, dtype)
        rows = products.select("o", x.re.alias("pre"), *([x.im.alias("pim")] if x.im is not None else []))
    if old is not None:
        held, at = labelled(old, old_labels, p.c.op)
        y = scaled(num(dtype), beta, dtype)
        base = held.select(linear(out, p.extent, at).alias("o"), y.re.alias("cre"), *([y.im.alias("cim")] if y.im is not None else []))
        if rows is None:
            rows = base
        elif old.dense:
            rows = base.join(rows, "o", "left")
        else:
            rows = base.join(rows, "o", "full")
    full = old is not None and old.dense or old is None and products is not None and always_full
    if rows is None or not (full or sparse):
        cells = products.sparkSession if products is not None else old.df.sparkSession if old is not None else None
        cells = (cells or _session()).range(product(dims)).select(F.col("id").alias("o"))
        rows = cells if rows is None else cells.join(rows, "o", "left")
    zero = F.lit(0.0)

    def total(c: str) -> Column:
        terms = [F.coalesce(F.col(s + c), zero) for s, there in (("p", products), ("c", old)) if there is not None]
        return sum(terms[1:], terms[0]) if terms else zero

    x = Num(total("re"), total("im") if dtype.complex else None)
    x = x.conj() if p.d.op is Op.CONJUGATE else x
    dense = not p.output_diagonal and (full or not sparse)
    strides = dict(zip(out, LayoutSpec.row_major(dims).strides, strict=True))
    at = {label: coordinate("o", strides[label], p.extent[label]) for label in out}
    cols = [at[label].alias(axis(i)) for i, label in enumerate(p.labels.d)]
    return Tensor(rows.select(*cols, x.pack(dtype).alias("v")), tuple(p.extent[x] for x in p.labels.d), dtype, dense)


def overlay(new: Tensor, old: Tensor) -> Tensor:
    """``old`` with the elements that ``new`` has written."""
    axes = [axis(i) for i in range(old.rank)]
    rest = old.df.join(new.df.select(*axes), axes, "left_anti") if axes else old.df.limit(0)
    return Tensor(new.df.unionByName(rest.select(*axes, "v")), old.dims, old.dtype, old.dense)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def permute(t: Tensor, perm: Sequence[int]) -> Tensor:
    """Axis i of the result is axis perm[i] of the tensor."""
    from sparkfold import errors as E

    if sorted(perm) != list(range(t.rank)):
        raise E.NotAPermutation(str(tuple(perm)))
    cols = [F.col(axis(p)).alias(axis(i)) for i, p in enumerate(perm)]
    return Tensor(t.df.select(*cols, "v"), tuple(t.dims[p] for p in perm), t.dtype, t.dense)


def add(alpha: complex, a: Tensor, beta: complex, c: Tensor) -> Tensor:
    """alpha * A + beta * C; a zero factor's operand is not read."""
    from sparkfold import errors as E

    if a.dims != c.dims:
        raise E.ExtentMismatch(f"{a.dims} and {c.dims}")
    if a.dtype != c.dtype:
        raise E.DtypeMismatch(f"{a.dtype} and {c.dtype}")
    axes, dtype = [axis(i) for i in range(a.rank)], a.dtype

    def one(t: Tensor, x: complex) -> Tensor:
        return t.replace(df=t.df.select(*axes, scaled(element(F.col("v"), dtype), x, dtype).pack(dtype).alias("v")))

    if beta == 0 or alpha == 0:
        if beta == 0 and alpha != 0:
            return one(a, alpha)
        if alpha == 0 and beta != 0:
            return one(c, beta)
        zero = Num(F.lit(0.0), F.lit(0.0) if dtype.complex else None).pack(dtype)
        return Tensor(grid(a.df.sparkSession, a.dims).select(*axes, zero.alias("v")), a.dims, dtype, True)
    both = a.df.select(*axes, F.col("v").alias("va")).join(c.df.select(*axes, F.col("v").alias("vc")), axes, "inner" if a.dense and c.dense else "full") if axes else a.df.select(F.col("v").alias("va")).crossJoin(c.df.select(F.col("v").alias("vc")))

    def side(col: str, x: complex) -> Num:
        return scaled(element(F.col(col), dtype).map(lambda v: F.coalesce(v, F.lit(0.0))), x, dtype)

    return Tensor(both.select(*axes, (side("va", alpha) + side("vc", beta)).pack(dtype).alias("v")), a.dims, dtype, a.dense or c.dense)
