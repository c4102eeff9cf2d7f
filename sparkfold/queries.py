"""Queries over the driver's tables and their SQL.

Tensors: Q[s,p] quantity by supplier and part, Z[p] part size, SN[s,n] supplier's nation, F[r,f] line counts by flags,
E[v,d] embeddings in thousandths, Y[v,c] their label, U[u,t] and W[u,t,h] event counts by user, type and hour. All values
are integers, so sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfold import operators as X
from sparkfold import plans as P
from sparkfold.functions import element
from sparkfold.meta import CSpec, DotGeneral, DType, Labels, LayoutSpec, Op, OperandSpec, einsum_labels
from sparkfold.problem import Problem
from sparkfold.sources import Tensor, axis, from_strided, from_table, small_ints, to_strided

#: Results of table queries are sparse: no grid of all elements is made.
SPARSE = P.PlanConfig(density="sparse")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return note


# --- tensors of the tables. Extents are one past the greatest key, an aggregate over the keys alone.


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _top(df: DataFrame, *cols: str) -> list[int]:
    got = df.agg(*[F.max(c) for c in cols]).first()
    return [int(x) + 1 if x is not None else 0 for x in got]


def q_tensor(spark: SparkSession, d: str) -> Tensor:
    s, p = _top(_t(spark, d, "supplier"), "s_suppkey")[0], _top(_t(spark, d, "part"), "p_partkey")[0]
    line = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return from_table(line, ["l_suppkey", "l_partkey"], "l_quantity", (s, p))


def c_tensor(spark: SparkSession, d: str) -> Tensor:
    """Quantities with counts as imaginary part."""
    q = q_tensor(spark, d)
    line = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    v = F.struct(F.col("l_quantity").alias("re"), F.lit(1.0).alias("im"))
    return from_table(line, ["l_suppkey", "l_partkey"], v, q.dims, "c64")


def z_tensor(spark: SparkSession, d: str) -> Tensor:
    part = _t(spark, d, "part")
    return from_table(part, ["p_partkey"], F.col("p_size").cast("double"), tuple(_top(part, "p_partkey")))


def sn_tensor(spark: SparkSession, d: str) -> Tensor:
    return from_table(_t(spark, d, "supplier"), ["s_suppkey", "s_nationkey"], F.lit(1.0), tuple(_top(_t(spark, d, "supplier"), "s_suppkey", "s_nationkey")))


def f_tensor(spark: SparkSession, d: str) -> Tensor:
    line = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return from_table(line, [F.ascii("l_returnflag") - 65, F.ascii("l_linestatus") - 65], F.lit(1.0), (26, 26))


def e_tensor(spark: SparkSession, d: str) -> Tensor:
    emb = _t(spark, d, "embeddings")
    cells = emb.select("vec_id", F.posexplode("embedding").alias("d", "x")).select("vec_id", "d", F.round(F.col("x").cast("double") * 1000).alias("x"))
    return from_table(cells, ["vec_id", "d"], "x", (_top(emb, "vec_id")[0], 64))


def y_tensor(spark: SparkSession, d: str) -> Tensor:
    emb = _t(spark, d, "embeddings").select("vec_id", "label")
    return from_table(emb, ["vec_id", "label"], F.lit(1.0), tuple(_top(emb, "vec_id", "label")))


#: Event types in order of their names, as the index of axis t.
_TYPES = "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS t FROM (SELECT DISTINCT event_type FROM events)"


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    ev = _t(spark, d, "events").select("user_id", "event_type", "ts")
    names = sorted(r[0] for r in ev.select("event_type").distinct().collect())
    code = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return ev.select("user_id", code[F.col("event_type")].cast("long").alias("t"), F.hour("ts").alias("h")), _top(ev, "user_id")[0], len(names)


def u_tensor(spark: SparkSession, d: str) -> Tensor:
    ev, users, types = _events(spark, d)
    return from_table(ev, ["user_id", "t"], F.lit(1.0), (users, types))


def w_tensor(spark: SparkSession, d: str) -> Tensor:
    ev, users, types = _events(spark, d)
    return from_table(ev, ["user_id", "t", "h"], F.lit(1.0), (users, types, 24))


_Q = "q AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)"
_W = f"ty AS ({_TYPES}), w AS (SELECT user_id AS u, t, hour(ts)::BIGINT AS h, count(*)::DOUBLE AS v FROM events JOIN ty USING (event_type) GROUP BY ALL)"
_U = "uu AS (SELECT u, t, sum(v) AS v FROM w GROUP BY ALL)"
_E = "e AS (SELECT vec_id AS v, unnest(range(len(embedding))) AS d, unnest(embedding) AS f FROM embeddings), ex AS (SELECT v, d, round(f::DOUBLE * 1000) AS x FROM e)"


def _rows(t: Tensor, *names: str, nonzero: bool = True) -> DataFrame:
    """The tensor's cells by name; of sparse results only those that differ from 0, as the SQL has them."""
    df = t.to_df(names, "value")
    return df.where(F.col("value") != 0) if nonzero else df


# --- queries over the tables


@query(
    f"WITH {_Q}, g AS (SELECT a.s, b.s AS t, sum(a.v * b.v) AS value FROM q a JOIN q b ON a.p = b.p GROUP BY ALL)"
    " SELECT x.s_suppkey AS s, y.s_suppkey AS t, coalesce(g.value, 0.0)::DOUBLE AS value FROM supplier x CROSS JOIN supplier y LEFT JOIN g ON g.s = x.s_suppkey AND g.t = y.s_suppkey"
)
def gram_supplier(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: co-supply of every two suppliers, dense. Where keys leave most of their range out, suppliers are
    numbered, so that D is the square of the suppliers and not of the greatest key."""
    supplier = _t(spark, d, "supplier").select("s_suppkey")
    keys = supplier.where("s_suppkey IS NOT NULL").distinct()
    n = keys.count()
    if _top(supplier, "s_suppkey")[0] > 2 * n:
        # D is the square of what this one task sorts.
        numbers = keys.select(F.col("s_suppkey").alias("key"), (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long").alias("i"))
        numbers = F.broadcast(numbers) if n * 16 <= X.BROADCAST_BYTES else numbers
        line = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(numbers, F.col("l_suppkey") == F.col("key"))
        q = from_table(line, ["i", "l_partkey"], "l_quantity", (n, _top(_t(spark, d, "part"), "p_partkey")[0]))
        g = P.contract("sp,tp->st", q, q).to_df(["i", "j"], "value")
        for i, name in (("i", "s"), ("j", "t")):
            g = g.join(numbers.select(F.col("i").alias(i), F.col("key").alias(name)), i)
        return g.select("s", "t", "value")
    q = q_tensor(spark, d)
    g = P.contract("sp,tp->st", q, q).to_df(["s", "t"], "value")
    keys = supplier
    # Bounded by the extents: D itself is the square of it.
    keys = F.broadcast(keys) if q.dims[0] * 8 <= X.BROADCAST_BYTES else keys
    return g.join(keys.withColumnRenamed("s_suppkey", "s"), "s", "left_semi").join(keys.withColumnRenamed("s_suppkey", "t"), "t", "left_semi").select("s", "t", "value")


@query(f"WITH {_Q} SELECT s, sum(v * p_size)::DOUBLE AS value FROM q JOIN part ON p = p_partkey GROUP BY s HAVING value <> 0")
def matvec_part_size(spark: SparkSession, d: str) -> DataFrame:
    return _rows(P.contract("sp,p->s", q_tensor(spark, d), z_tensor(spark, d), config=SPARSE), "s")


@query(f"WITH {_Q} SELECT s_nationkey::BIGINT AS n, p, sum(v)::DOUBLE AS value FROM q JOIN supplier ON s = s_suppkey GROUP BY ALL HAVING sum(v) <> 0")
def matmul_nation_part(spark: SparkSession, d: str) -> DataFrame:
    return _rows(P.contract("sn,sp->np", sn_tensor(spark, d), q_tensor(spark, d), config=SPARSE), "n", "p")


@query(f"WITH {_W} SELECT a.u, a.t, b.t AS s, sum(a.v * b.v) AS value FROM w a JOIN w b ON a.u = b.u AND a.h = b.h GROUP BY ALL")
def batched_user_hours(spark: SparkSession, d: str) -> DataFrame:
    w = w_tensor(spark, d)
    return _rows(P.contract("uth,ush->uts", w, w, config=SPARSE), "u", "t", "s")


@query(f"WITH {_W} SELECT a.u, b.u AS v, sum(a.v * b.v) AS value FROM w a JOIN w b ON a.t = b.t AND a.h = b.h GROUP BY ALL")
def multi_contract(spark: SparkSession, d: str) -> DataFrame:
    w = w_tensor(spark, d)
    return _rows(P.contract("uth,vth->uv", w, w, config=SPARSE), "u", "v")


@query(
    "WITH f AS (SELECT ascii(l_returnflag)::BIGINT - 65 AS r, ascii(l_linestatus)::BIGINT - 65 AS f, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL)"
    " SELECT p_partkey AS p, r, f, p_size * v AS value FROM part CROSS JOIN f WHERE p_size * v <> 0"
)
def outer_size_flags(spark: SparkSession, d: str) -> DataFrame:
    return _rows(P.contract("p,rf->prf", z_tensor(spark, d), f_tensor(spark, d), config=SPARSE), "p", "r", "f")


@query(f"WITH {_Q} SELECT sum(v * v)::DOUBLE AS value FROM q")
def full_contract_scalar(spark: SparkSession, d: str) -> DataFrame:
    q = q_tensor(spark, d)
    return _rows(P.contract("sp,sp->", q, q, config=SPARSE))


@query(f"WITH {_W}, {_U} SELECT u, t, v * v AS value FROM uu")
def hadamard_user_type(spark: SparkSession, d: str) -> DataFrame:
    u = u_tensor(spark, d)
    return _rows(P.contract("ut,ut->ut", u, u, config=SPARSE), "u", "t")


@query(f"WITH {_E} SELECT v, sum(x * x) AS value FROM ex GROUP BY v HAVING sum(x * x) <> 0")
def rowwise_sqnorm(spark: SparkSession, d: str) -> DataFrame:
    e = e_tensor(spark, d)
    return _rows(P.contract("vd,vd->v", e, e, config=SPARSE), "v")


@query(f"WITH {_W}, {_U}, r AS (SELECT u, t, sum(v) AS v FROM w GROUP BY ALL) SELECT r.u, b.u AS s, sum(r.v * b.v) AS value FROM r JOIN uu b ON r.t = b.t GROUP BY ALL")
def isolated_reduce_a(spark: SparkSession, d: str) -> DataFrame:
    return _rows(P.contract("uth,st->us", w_tensor(spark, d), u_tensor(spark, d), config=SPARSE), "u", "s")


@query(f"WITH {_W}, {_U}, r AS (SELECT u, t, sum(v) AS v FROM w GROUP BY ALL) SELECT r.u, b.u AS s, sum(r.v * b.v) AS value FROM r JOIN uu b ON r.t = b.t GROUP BY ALL")
def isolated_reduce_b(spark: SparkSession, d: str) -> DataFrame:
    return _rows(P.contract("st,uth->us", u_tensor(spark, d), w_tensor(spark, d), config=SPARSE), "u", "s")


@query(
    f"WITH {_Q}, g AS (SELECT a.s AS i, b.s AS j, sum(a.v * b.v) AS v FROM q a JOIN q b ON a.p = b.p GROUP BY ALL)"
    " SELECT y.j, sum(x.v * y.v) AS value FROM g x JOIN g y ON x.i = y.i WHERE x.i = x.j GROUP BY y.j"
)
def diag_input(spark: SparkSession, d: str) -> DataFrame:
    q = q_tensor(spark, d)
    g = P.contract("sp,tp->st", q, q, config=SPARSE)
    return _rows(P.contract("ii,ij->j", g, g, config=P.PlanConfig(density="sparse", orient="ba")), "j")


@query(f"WITH {_Q} SELECT b.s, a.s AS t, 2 * sum(a.v * b.v) AS value FROM q a JOIN q b ON a.p = b.p GROUP BY ALL")
def output_permuted(spark: SparkSession, d: str) -> DataFrame:
    q = q_tensor(spark, d)
    return _rows(P.contract("sp,tp->ts", q, q, alpha=2, config=SPARSE), "t", "s")


@query(f"WITH {_W} SELECT h, u, t, v AS value FROM w")
def permute3(spark: SparkSession, d: str) -> DataFrame:
    return _rows(X.permute(w_tensor(spark, d), (2, 0, 1)), "h", "u", "t")


@query(f"WITH {_W}, {_U} SELECT coalesce(a.u, b.u) AS u, coalesce(a.t, b.t) AS t, 2 * coalesce(a.v, 0) + 3 * coalesce(b.v, 0) AS value FROM uu a FULL JOIN (SELECT u, t, sum(v) AS v FROM w WHERE h < 12 GROUP BY ALL) b ON a.u = b.u AND a.t = b.t")
def add_scaled(spark: SparkSession, d: str) -> DataFrame:
    ev, users, types = _events(spark, d)
    morning = from_table(ev.where("h < 12"), ["user_id", "t"], F.lit(1.0), (users, types))
    return _rows(X.add(2, u_tensor(spark, d), 3, morning), "u", "t")


@query(
    "WITH f AS (SELECT l_returnflag AS f, l_suppkey AS s, sum(l_quantity * p_size) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
    " SELECT CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::INT AS item, s, v * CASE f WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS value FROM f WHERE f IN ('A', 'N', 'R') AND v <> 0"
)
def batched_items(spark: SparkSession, d: str) -> DataFrame:
    """Three factors over the quantities of three return flags, one job."""
    z, dims = z_tensor(spark, d), q_tensor(spark, d).dims
    line = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    items = []
    for i, flag in enumerate("ANR"):
        q = from_table(line.where(F.col("l_returnflag") == flag), ["l_suppkey", "l_partkey"], "l_quantity", dims)
        items.append(P.BatchItem(P.Plan(Problem.einsum("f64", "sp,p->s", q.dims, z.dims), SPARSE), i + 1, q, z))
    return P.batched_frame(items).select("item", F.col(axis(0)).alias("s"), F.col("v").alias("value")).where("value <> 0")


def _complex(t: Tensor, *names: str) -> DataFrame:
    return t.to_df(names, "x").select(*names, "x.re", "x.im").where("re <> 0 or im <> 0")


@query(
    f"WITH {_Q} SELECT a.s, b.s AS t, sum(a.v * b.v - a.n * b.n)::DOUBLE AS re, sum(a.v * b.n + a.n * b.v)::DOUBLE AS im FROM q a JOIN q b ON a.p = b.p GROUP BY ALL"
)
def complex_matmul(spark: SparkSession, d: str) -> DataFrame:
    c = c_tensor(spark, d)
    return _complex(P.contract("sp,tp->st", c, c, config=SPARSE), "s", "t")


@query(
    f"WITH {_Q} SELECT a.s, b.s AS t, sum(a.v * b.v + a.n * b.n)::DOUBLE AS re, sum(a.v * b.n - a.n * b.v)::DOUBLE AS im FROM q a JOIN q b ON a.p = b.p GROUP BY ALL"
)
def conj_a(spark: SparkSession, d: str) -> DataFrame:
    c = c_tensor(spark, d)
    return _complex(P.contract("sp,tp->st", c, c, conj="a", config=SPARSE), "s", "t")


@query(
    f"WITH {_Q}, g AS (SELECT a.s, b.s AS t, sum(a.v * b.v - a.n * b.n) AS re, sum(a.v * b.n + a.n * b.v) AS im FROM q a JOIN q b ON a.p = b.p GROUP BY ALL)"
    " SELECT s, t, 3 * re AS re, -(2 * im - im) AS im FROM g"
)
def conj_d_beta_c(spark: SparkSession, d: str) -> DataFrame:
    """conj(2 A B + conj(C)) with C = A B."""
    c = c_tensor(spark, d)
    g = P.contract("sp,tp->st", c, c, config=SPARSE)
    p = Problem.einsum("c64", "sp,tp->st", c.dims, c.dims, conj="cd")
    return _complex(P.Plan(p, SPARSE).execute_accum(c, c, 2, 1, d_old=g), "s", "t")


@query(f"WITH {_E} SELECT label::BIGINT AS c, d, sum(x) AS value FROM ex JOIN embeddings ON v = vec_id GROUP BY ALL HAVING sum(x) <> 0")
def label_centroid_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rows(P.contract("vc,vd->cd", y_tensor(spark, d), e_tensor(spark, d), config=SPARSE), "c", "d")


_EGRAM = f"WITH {_E} SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS value FROM ex a JOIN ex b ON a.v = b.v GROUP BY ALL HAVING sum(a.x * b.x) <> 0"


@query(_EGRAM)
def block_gemm_gram(spark: SparkSession, d: str) -> DataFrame:
    e = e_tensor(spark, d)
    return _rows(P.contract("vi,vj->ij", e, e, config=P.PlanConfig(density="sparse", strategy="block_gemm")), "i", "j")


@query(f"WITH {_E}, g AS (SELECT a.v, b.v AS w, sum(a.x * b.x) AS value FROM ex a JOIN ex b ON a.d = b.d GROUP BY ALL) SELECT v, w, value FROM g WHERE value >= 600000")
def vector_gram(spark: SparkSession, d: str) -> DataFrame:
    """Products of all vectors, dense: the choice falls on blocks. The result keeps the large ones."""
    e = e_tensor(spark, d)
    return P.contract("vd,wd->vw", e, e, config=P.PlanConfig(density="sparse", least=600_000)).to_df(["v", "w"], "value")


@query(f"WITH {_W} SELECT a.u, a.t, b.t AS s, sum(a.v * b.v) AS value FROM w a JOIN w b ON a.u = b.u AND a.h = b.h GROUP BY ALL")
def block_gemm_batched(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with a batch label."""
    w = w_tensor(spark, d)
    return _rows(P.contract("uth,ush->uts", w, w, config=P.PlanConfig(density="sparse", strategy="block_gemm", block_size=8)), "u", "t", "s")


@query(f"WITH {_Q} SELECT i.item, s, sum(v * p_size * (i.item + 1))::DOUBLE AS value FROM q JOIN part ON p = p_partkey CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS item) i GROUP BY ALL HAVING value <> 0")
def batched_products(spark: SparkSession, d: str) -> DataFrame:
    """Three products of one plan in one contraction, with factors 1, 2 and 3."""
    q, z = q_tensor(spark, d), z_tensor(spark, d)
    p = P.Plan(Problem.einsum("f64", "sp,p->s", q.dims, z.dims), SPARSE)
    return P.batched_frame([P.BatchItem(p, i + 1, q, z) for i in range(3)]).where("v <> 0").select("item", F.col(axis(0)).alias("s"), F.col("v").alias("value"))


@query(f"WITH {_Q} SELECT s, p, sqrt(v * v + n * n) AS value FROM q")
def element_norm(spark: SparkSession, d: str) -> DataFrame:
    c = c_tensor(spark, d)
    return c.df.select(F.col(axis(0)).alias("s"), F.col(axis(1)).alias("p"), element(F.col("v"), c.dtype).norm().alias("value"))


@query(f"WITH {_Q} SELECT s, sum(v * (p_size + p_size))::DOUBLE AS value FROM q JOIN part ON p = p_partkey GROUP BY s HAVING value <> 0")
def strict_isolated(spark: SparkSession, d: str) -> DataFrame:
    """An isolated label of B that isn't summed before the join, in key order."""
    q, z = q_tensor(spark, d), z_tensor(spark, d)
    twice = z.replace(df=z.df.crossJoin(spark.range(2).select(F.col("id").alias(axis(1)))), dims=(*z.dims, 2))
    return _rows(P.contract("sp,pr->s", q, twice, config=P.PlanConfig(density="sparse", strict_nonfinite=True, deterministic=True)), "s")


@query(_EGRAM)
def deterministic_gram(spark: SparkSession, d: str) -> DataFrame:
    e = e_tensor(spark, d)
    return _rows(P.contract("vi,vj->ij", e, e, config=P.PlanConfig(density="sparse", strategy="join_agg", deterministic=True)), "i", "j")


@query(f"WITH {_Q} SELECT a.s, b.s AS t, sum(a.v * b.v)::DOUBLE AS value FROM q a JOIN q b ON a.p = b.p GROUP BY ALL")
def accumulate_over_slices(spark: SparkSession, d: str) -> DataFrame:
    """D += A B over two halves of the parts gives the whole."""
    q = q_tensor(spark, d)
    p = P.Plan(Problem.einsum("f64", "sp,tp->st", q.dims, q.dims), SPARSE)
    odd, even = (q.replace(df=q.df.where(F.col(axis(1)) % 2 == i)) for i in (1, 0))
    return _rows(p.execute_accum(even, even, 1, 1, d_old=p.execute(odd, odd)), "s", "t")


# --- queries over generated tensors


def _sql_tensor(name: str, dims: list[int] | tuple[int, ...], seed: int, im: bool = False) -> str:
    n = 1
    for x in dims:
        n *= x
    strides = LayoutSpec.row_major(dims).strides
    cols = [f"(o // {s} % {max(x, 1)})::BIGINT AS x{i}" for i, (x, s) in enumerate(zip(dims, strides, strict=True))]
    cols.append(f"((5 * o + {3 * seed}) % 13 - 6)::DOUBLE AS v")
    if im:
        cols.append(f"((7 * o + {seed + 1}) % 11 - 5)::DOUBLE AS w")
    return f"{name} AS (SELECT {', '.join(cols)} FROM range({n}) r(o))"


def _sql_contract(spec: str, a: str = "a", b: str = "b", value: str = "sum(a.v * b.v)") -> str:
    labels = einsum_labels(spec)
    first = {}
    conds = []
    for t, ls in ((a, labels.a), (b, labels.b)):
        for i, x in enumerate(ls):
            if x in first:
                conds.append(f"{first[x]} = {t}.x{i}")
            else:
                first[x] = f"{t}.x{i}"
    out = ", ".join(f"{first[x]} AS {chr(x)}" for x in dict.fromkeys(labels.d))
    keys = ", ".join(first[x] for x in dict.fromkeys(labels.d))
    return f"SELECT {out + ', ' if out else ''}{value}::DOUBLE AS value FROM {a}, {b}" + (f" WHERE {' AND '.join(conds)}" if conds else "") + (f" GROUP BY {keys}" if keys else "")


def _extents(spec: str) -> dict[str, int]:
    """Extents 2 to 4 by place among the labels."""
    return {x: 2 + i % 3 for i, x in enumerate(sorted(set(spec) - set(",->")))}


def _add_generated(name: str, spec: str, config: P.PlanConfig | None = None) -> None:
    e = _extents(spec)
    left, d_labels = spec.split("->")
    a_dims, b_dims = ([e[x] for x in s] for s in left.split(","))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return P.contract(spec, small_ints(spark, a_dims, 1), small_ints(spark, b_dims, 2), config=config).to_df(list(d_labels), "value")

    QUERIES[name] = run
    SQL[name] = f"WITH {_sql_tensor('a', a_dims, 1)}, {_sql_tensor('b', b_dims, 2)} {_sql_contract(spec)}"


# The contractions of the public TCCG benchmark, written output-A-B, in its groups.
TCCG = """
ij-ik-kj ij-ikl-ljk ij-kil-lkj ijk-ikl-lj ijk-il-jlk ijk-ilk-jl ijk-ilk-lj ijk-ilmk-mjl ijkl-imjn-lnkm ijkl-imjn-nlmk
ijkl-imkn-jnlm ijkl-imkn-njml ijkl-imln-jnkm ijkl-imln-njmk ijkl-imnj-nlkm ijkl-imnk-njml ijkl-minj-nlmk
ijkl-mink-jnlm ijkl-minl-njmk
aqrs-pa-pqrs abrs-qb-aqrs abcs-rc-abrs
abj-bka-kj ajb-kba-jk abjc-cbka-kj ajbc-ckba-jk abjc-kbac-jk abjcd-dkbac-jk adbjc-cbdka-kj ajbdc-ckbad-jk
abcijk-ijma-mkbc abcijk-ijmb-mkac abcijk-ijmc-mkab abcijk-ikma-mjbc abcijk-ikmb-mjac abcijk-ikmc-mjab
abcijk-jkma-mibc abcijk-jkmb-miac abcijk-jkmc-miab abcijk-eiab-jkec abcijk-eiac-jkeb abcijk-eibc-jkea
abcijk-ejab-ikec abcijk-ejac-ikeb abcijk-ejbc-ikea abcijk-ekab-ijec abcijk-ekac-ijeb abcijk-ekbc-ijea
abc-bk-akc
""".split()

for _spec in TCCG:
    _c, _a, _b = _spec.split("-")
    _add_generated("tccg_" + _spec.replace("-", "_"), f"{_a},{_b}->{_c}")
for _name, _spec in (("diag_triple", "iii,ij->j"), ("outer_rank2", "ij,kl->ijkl"), ("batch_middle", "ihk,khj->ijh"), ("network", "abcd,cdef->abef"), ("isolated_both", "ikr,kjq->ij")):
    _add_generated(_name, _spec)
_add_generated("block_gemm_network", "abcd,cdef->abef", P.PlanConfig(strategy="block_gemm", block_size=3))

_AB = f"{_sql_tensor('a', (7, 5), 1)}, {_sql_tensor('b', (5, 6), 2)}, g AS ({_sql_contract('ik,kj->ij')})"


def _ab(spark: SparkSession) -> tuple[Tensor, Tensor]:
    return small_ints(spark, (7, 5), 1), small_ints(spark, (5, 6), 2)


@query(f"WITH {_AB}, {_sql_tensor('d', (7, 6), 3)} SELECT i, j, 2 * g.value + 3 * d.v AS value FROM g JOIN d ON d.x0 = i AND d.x1 = j")
def alpha_beta_in_place(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark)
    p = P.Plan(Problem.einsum("f64", "ik,kj->ij", a.dims, b.dims))
    return p.execute_accum(a, b, 2, 3, d_old=small_ints(spark, (7, 6), 3)).to_df(["i", "j"], "value")


@query(f"WITH {_AB}, {_sql_tensor('c', (6, 7), 3)} SELECT i, j, 2 * g.value - c.v AS value FROM g JOIN c ON c.x1 = i AND c.x0 = j")
def separate_c(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark)
    c = CSpec.separate(OperandSpec.of((6, 7)))
    p = P.Plan(Problem.einsum("f64", "ik,kj->ij", a.dims, b.dims, c=c, c_labels="ji"))
    return p.execute_accum(a, b, 2, -1, c=small_ints(spark, (6, 7), 3)).to_df(["i", "j"], "value")


@query(f"WITH {_AB} SELECT i, j, value FROM g")
def beta_zero_nan_c(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark)
    bad = small_ints(spark, (7, 6), 3)
    bad = bad.replace(df=bad.df.withColumn("v", F.lit(float("nan"))))
    return P.Plan(Problem.einsum("f64", "ik,kj->ij", a.dims, b.dims)).execute_accum(a, b, 1, 0, d_old=bad).to_df(["i", "j"], "value")


@query(f"WITH {_sql_tensor('d', (7, 6), 3)} SELECT x0 AS i, x1 AS j, 2 * v AS value FROM d")
def alpha_zero_nan_ab(spark: SparkSession, d: str) -> DataFrame:
    a, b = (t.replace(df=t.df.withColumn("v", F.lit(float("nan")))) for t in _ab(spark))
    return P.Plan(Problem.einsum("f64", "ik,kj->ij", a.dims, b.dims)).execute_accum(a, b, 0, 2, d_old=small_ints(spark, (7, 6), 3)).to_df(["i", "j"], "value")


@query("SELECT (o // 5)::BIGINT AS i, (o % 5)::BIGINT AS j, 0.0::DOUBLE AS value FROM range(20) r(o)")
def empty_k(spark: SparkSession, d: str) -> DataFrame:
    return P.contract("ik,kj->ij", small_ints(spark, (4, 0), 1), small_ints(spark, (0, 5), 2)).to_df(["i", "j"], "value")


@query("SELECT 0::BIGINT AS i, 0::BIGINT AS j, 0.0::DOUBLE AS value WHERE false")
def empty_output(spark: SparkSession, d: str) -> DataFrame:
    return P.contract("ik,kj->ij", small_ints(spark, (0, 3), 1), small_ints(spark, (3, 2), 2)).to_df(["i", "j"], "value")


@query(
    f"WITH {_sql_tensor('a', (4, 3), 1)}, {_sql_tensor('b', (3,), 2)}, {_sql_tensor('d', (4, 4), 3)}, g AS ({_sql_contract('ik,k->i')})"
    " SELECT x0 AS i, x1 AS j, CASE WHEN x0 = x1 THEN g.value ELSE d.v END AS value FROM d LEFT JOIN g ON g.i = x0"
)
def diag_output(spark: SparkSession, d: str) -> DataFrame:
    """Only the diagonal of D is written."""
    a, b = small_ints(spark, (4, 3), 1), small_ints(spark, (3,), 2)
    return P.Plan(Problem.einsum("f64", "ik,k->ii", a.dims, b.dims)).execute(a, b, d_old=small_ints(spark, (4, 4), 3)).to_df(["i", "j"], "value")


@query(f"WITH {_sql_tensor('d', (7, 6), 3)} SELECT x0 AS i, x1 AS j, v AS value FROM d")
def identity_update(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark)
    return P.Plan(Problem.einsum("f64", "ik,kj->ij", a.dims, b.dims)).execute_accum(a, b, 0, 1, d_old=small_ints(spark, (7, 6), 3)).to_df(["i", "j"], "value")


@query(f"WITH {_sql_tensor('a', (3, 4), 1)}, {_sql_tensor('b', (4, 5), 2)} {_sql_contract('ik,kj->ij')}")
def dot_general_matmul(spark: SparkSession, d: str) -> DataFrame:
    a, b = small_ints(spark, (3, 4), 1), small_ints(spark, (4, 5), 2)
    p = Problem.from_dot_general("f64", OperandSpec.of(a.dims), OperandSpec.of(b.dims), None, DotGeneral((1,), (0,)))
    return P.Plan(p).execute(a, b).to_df(["i", "j"], "value")


@query(f"WITH {_sql_tensor('a', (2, 3, 4), 1)}, {_sql_tensor('b', (4, 2, 5), 2)} {_sql_contract('hik,khj->ijh')}")
def dot_general_batched(spark: SparkSession, d: str) -> DataFrame:
    a, b = small_ints(spark, (2, 3, 4), 1), small_ints(spark, (4, 2, 5), 2)
    p = Problem.from_dot_general("f64", OperandSpec.of(a.dims), OperandSpec.of(b.dims), None, DotGeneral((2,), (0,), (0,), (1,)))
    return P.Plan(p).execute(a, b).to_df(["i", "j", "h"], "value")


@query(
    f"WITH {_sql_tensor('a', (6, 7), 1, True)}, {_sql_tensor('b', (7, 5), 2, True)}"
    " SELECT a.x0 AS i, b.x1 AS j, sum(a.v * b.v - a.w * b.w) AS re, sum(a.v * b.w + a.w * b.v) AS im FROM a JOIN b ON a.x1 = b.x0 GROUP BY ALL"
)
def block_gemm_3m(spark: SparkSession, d: str) -> DataFrame:
    a, b = small_ints(spark, (6, 7), 1, "c64"), small_ints(spark, (7, 5), 2, "c64")
    c = P.PlanConfig(strategy="block_gemm", block_size=4, complex_method="3m")
    return P.contract("ik,kj->ij", a, b, config=c).to_df(["i", "j"], "x").select("i", "j", "x.re", "x.im")


@query(f"WITH {_sql_tensor('a', (3, 4), 1)}, {_sql_tensor('b', (3, 4), 2)} SELECT a.x0 AS i, a.x1 AS j, (a.v * b.v)::FLOAT AS value FROM a JOIN b ON a.x0 = b.x0 AND a.x1 = b.x1")
def hadamard_f32(spark: SparkSession, d: str) -> DataFrame:
    return P.contract("ij,ij->ij", small_ints(spark, (3, 4), 1, "f32"), small_ints(spark, (3, 4), 2, "f32")).to_df(["i", "j"], "value")


@query("SELECT (o // 4)::BIGINT AS i, (o % 4)::BIGINT AS j, (11 - o // 4 - 3 * (o % 4))::DOUBLE AS value FROM range(12) r(o)")
def strided_reversed(spark: SparkSession, d: str) -> DataFrame:
    """A buffer of 0..11 read backwards along both axes."""
    flat = spark.range(12).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    return from_strided(flat, LayoutSpec((3, 4), (-1, -3), 11)).to_df(["i", "j"], "value")


@query("SELECT (o // 4 + 3 * (o % 4))::BIGINT AS pos, ((5 * o + 3) % 13 - 6)::DOUBLE AS v FROM range(12) r(o)")
def strided_write(spark: SparkSession, d: str) -> DataFrame:
    return to_strided(small_ints(spark, (3, 4), 1), LayoutSpec.col_major((3, 4)))


__all__ = ["QUERIES", "SQL", "DType", "Labels", "Op"]
