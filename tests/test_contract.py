"""Contractions against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold import errors as E
from sparkfold import operators as X
from sparkfold.meta import CSpec, DType, LayoutSpec, OperandSpec
from sparkfold.plans import BatchItem, NumpyBackend, Plan, PlanConfig, PlanningBudget, Requirements, SparkBackend, TileCatalog, batched_frame, contract, contract_batched, execute_batched
from sparkfold.problem import Problem
from sparkfold.sources import Tensor, check_sink, from_numpy, from_strided, from_table, small_ints, to_numpy, to_strided, write_tensor


def close(got, want, single=False):
    assert got.shape == want.shape
    assert np.linalg.norm(got - want) <= (2e-4 if single else 1e-11) * max(1.0, np.linalg.norm(want))


def arrays(rng, dims, dtype):
    x = rng.integers(-5, 6, dims).astype(float)
    if dtype.startswith("c"):
        x = x + 1j * rng.integers(-5, 6, dims)
    return x.astype({"f32": np.float32, "f64": np.float64, "c32": np.complex64, "c64": np.complex128}[dtype])


CASES = ["ik,kj->ij", "hik,khj->ijh", "abc,cdb->ad", "i,jk->kij", "ij,ji->", "ij,ji->ij", "ii,ij->j", "iii,ij->j", "ikr,kj->ij", "ik,kjr->ij", "ikl,kj->ij", "ijj,i->i"]


@pytest.mark.parametrize("spec", CASES)
@pytest.mark.parametrize("strategy", ["auto", "join_agg", "block_gemm"])
def test_cases(spark, spec, strategy):
    rng = np.random.default_rng(len(spec))
    left = spec.split("->")[0].split(",")
    e = {x: 2 + i for i, x in enumerate(sorted(set("".join(left))))}
    a, b = (arrays(rng, [e[x] for x in s], "f64") for s in left)
    try:
        got = contract(spec, from_numpy(spark, a), from_numpy(spark, b), config=PlanConfig(strategy=strategy, block_size=2))
    except E.StrategyRefused:
        return
    close(to_numpy(got), np.einsum(spec, a, b))


def test_random_sweep(spark):
    rnd, rng = random.Random(3), np.random.default_rng(3)
    for n in range(12):
        m, nn, k, h, ra, rb = "ab"[: rnd.randint(0, 2)], "cd"[: rnd.randint(0, 2)], "ef"[: rnd.randint(1, 2)], "g"[: rnd.randint(0, 1)], "r"[: rnd.randint(0, 1)], "s"[: rnd.randint(0, 1)]
        la, lb, ld = list(m + k + h + ra), list(nn + k + h + rb), list(m + nn + h)
        if rnd.random() < 0.25:
            la.append(rnd.choice(la))
        for x in (la, lb, ld):
            rnd.shuffle(x)
        e = {x: rnd.randint(1, 4) for x in "abcdefgrs"}
        dtype = rnd.choice(["f64", "c64", "f32", "c32"])
        conj = "".join(x for x in "abd" if rnd.random() < 0.3)
        a, b = arrays(rng, [e[x] for x in la], dtype), arrays(rng, [e[x] for x in lb], dtype)
        spec = f"{''.join(la)},{''.join(lb)}->{''.join(ld)}"
        got = to_numpy(contract(spec, from_numpy(spark, a), from_numpy(spark, b), conj=conj))
        want = np.einsum(spec, a.conj() if "a" in conj else a, b.conj() if "b" in conj else b)
        close(got, want.conj() if "d" in conj else want, dtype in ("f32", "c32"))


def test_hand_checked(spark):
    one = lambda x: from_numpy(spark, np.array([[x]]))
    assert to_numpy(contract("ik,kj->ij", one(1 + 2j), one(3 + 4j)))[0, 0] == -5 + 10j
    a = np.arange(1.0, 7).reshape(2, 3)
    assert to_numpy(contract("ik,kj->ij", from_numpy(spark, a), from_numpy(spark, a.reshape(3, 2)))).tolist() == [[22, 28], [49, 64]]


@pytest.mark.parametrize("conj", ["", "c", "cd", "abd"])
def test_c_modes(spark, conj):
    rng = np.random.default_rng(5)
    a, b, c = arrays(rng, (3, 4), "c64"), arrays(rng, (4, 2), "c64"), arrays(rng, (2, 3), "c64")
    f = lambda x, n: x.conj() if n in conj else x
    alpha, beta = 0.75 - 1.5j, -0.5 + 0.25j
    from sparkfold.meta import Op

    op = Op.CONJUGATE if "c" in conj else Op.IDENTITY
    p = Problem.einsum("c64", "ik,kj->ij", (3, 4), (4, 2), conj, CSpec.separate(OperandSpec(LayoutSpec.row_major((2, 3)), op)), "ji")
    ta, tb, tc = (from_numpy(spark, x) for x in (a, b, c))
    product = f(a, "a") @ f(b, "b")
    close(to_numpy(Plan(p).execute_accum(ta, tb, alpha, beta, tc)), f(alpha * product + beta * f(c, "c").T, "d"))
    q = Problem.einsum("c64", "ik,kj->ij", (3, 4), (4, 2), conj)
    close(to_numpy(Plan(q).execute_accum(ta, tb, alpha, beta, d_old=from_numpy(spark, c.T.copy()))), f(alpha * product + beta * f(c.T, "c"), "d"))


def test_nan_is_not_read(spark):
    nan = from_numpy(spark, np.full((2, 2), np.nan))
    one = from_numpy(spark, np.ones((2, 2)))
    p = Plan(Problem.einsum("f64", "ik,kj->ij", (2, 2), (2, 2)))
    assert to_numpy(p.execute_accum(one, one, 1, 0, d_old=nan)).tolist() == [[2, 2], [2, 2]]
    assert to_numpy(p.execute_accum(nan, nan, 0, 3, d_old=one)).tolist() == [[3, 3], [3, 3]]
    assert to_numpy(p.execute_accum(nan, nan, 0, 0)).tolist() == [[0, 0], [0, 0]]
    assert p.execute_accum(nan, nan, 0, 1, d_old=one) is one
    assert to_numpy(X.add(1, one, 0, nan)).tolist() == [[1, 1], [1, 1]]


def test_empty_and_scalar(spark):
    z = lambda *d: from_numpy(spark, np.zeros(d))
    assert to_numpy(contract("ik,kj->ij", z(2, 0), z(0, 3))).tolist() == [[0] * 3] * 2
    assert to_numpy(contract("ik,kj->ij", z(0, 2), z(2, 3))).shape == (0, 3)
    s = from_numpy(spark, np.array(3.0))
    assert to_numpy(contract(",->", s, s)).item() == 9


def test_output_diagonal_keeps_the_rest(spark):
    a, b, d = np.ones((3, 2)), np.array([1.0, 2]), np.full((3, 3), 7.0)
    p = Plan(Problem.einsum("f64", "ik,k->ii", (3, 2), (2,)))
    got = to_numpy(p.execute(from_numpy(spark, a), from_numpy(spark, b), d_old=from_numpy(spark, d)))
    assert got.tolist() == [[3, 7, 7], [7, 3, 7], [7, 7, 3]]


def test_binding_is_checked(spark):
    p = Plan(Problem.einsum("f64", "ik,kj->ij", (2, 2), (2, 2)))
    one, other = from_numpy(spark, np.ones((2, 2))), from_numpy(spark, np.ones((2, 3)))
    with pytest.raises(E.Mismatch):
        p.execute(one, other)
    with pytest.raises(E.DtypeMismatch):
        p.execute(one, from_numpy(spark, np.ones((2, 2), np.float32)))
    with pytest.raises(E.CMode):
        p.execute_accum(one, one, 1, 1)
    with pytest.raises(E.CMode):
        p.execute_accum(one, one, 1, 1, c=one)


def test_batches(spark):
    one = from_numpy(spark, np.ones((2, 2)))
    p = Plan(Problem.einsum("f64", "ik,kj->ij", (2, 2), (2, 2)))
    out = contract_batched([BatchItem(p, 1, one, one), BatchItem(p, 2, one, one, 1, d_old=one)])
    assert [to_numpy(x)[0, 0] for x in out] == [2, 5]
    with pytest.raises(E.Mismatch):
        contract_batched([BatchItem(p, 1, one, one), BatchItem(p, 1, one, from_numpy(spark, np.ones(2)))])
    assert batched_frame([BatchItem(p, 1, one, one)] * 2).count() == 8
    assert len(execute_batched(p, [one, one], [one, one], 3)) == 2 and execute_batched(p, [], []) == []
    with pytest.raises(E.CMode):
        execute_batched(p, [one], [one], 1, 1)


def test_batch_is_one_contraction(spark):
    rng = np.random.default_rng(4)
    p = Plan(Problem.einsum("c64", "ik,kj->ij", (2, 3), (3, 2), "ac"))
    ts = [[from_numpy(spark, arrays(rng, x, "c64")) for x in ((2, 3), (3, 2), (2, 2))] for _ in range(3)]
    items = [BatchItem(p, 1 + 2j, a, b) for a, b, _ in ts] + [BatchItem(p, 2j, a, b, 1j, d_old=c) for a, b, c in ts] + [BatchItem(p, 0, *ts[0][:2])]
    want = [to_numpy(t) for t in contract_batched(items)]
    got = batched_frame(items)
    assert got.count() == 28
    for r in got.collect():
        assert abs(complex(r.v["re"], r.v["im"]) - want[r["item"]][r.x0, r.x1]) < 1e-9
    with pytest.raises(E.Mismatch, match="item 1"):
        contract_batched([items[3], BatchItem(p, 1, *ts[0][:2], 1, d_old=from_numpy(spark, np.ones((3, 3), complex)))])


def test_choice_by_counted_rows(spark):
    """Full operands go to blocks, sparse ones of the same extents to the join; the report has the figures."""
    n, wide = 512, 4096
    cells = spark.range(wide).select(F.col("id"), F.col("id") % 999, F.lit(1.0)).toDF("x0", "x1", "v")
    sparse = Tensor(cells, (wide, wide), DType.F64, False)
    full = small_ints(spark, (n, n), 1)
    p = Problem.einsum("f64", "ik,jk->ij", (n, n), (n, n))
    for t, kind in ((sparse, "join_agg"), (full, "block_gemm")):
        p = Problem.einsum("f64", "ik,jk->ij", t.dims, t.dims)
        x = Plan(p, PlanConfig(density="sparse"))
        out = x.execute(t, t)
        assert x.algorithm == f"{kind}.f64" and x.report.join_rows > 0 and x.report.materialized == (kind == "block_gemm")
        if t is sparse:
            y = Plan(p, PlanConfig(density="sparse", strategy="block_gemm", block_size=1000)).execute(t, t)
            assert sorted(map(tuple, out.df.where("v <> 0").collect())) == sorted(map(tuple, y.df.where("v <> 0").collect()))
    assert Plan(p, PlanConfig(no_materialize=True, density="sparse")).execute(full, full) and not Plan(p, PlanConfig(no_materialize=True)).open


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(X, "MEET", 4)
    monkeypatch.setattr(X, "HOT", 16)
    rng = np.random.default_rng(3)
    a, b = arrays(rng, (30, 3), "f64"), arrays(rng, (3, 20), "f64")
    x, y = from_numpy(spark, a), from_numpy(spark, b)
    p = Problem.einsum("f64", "ik,kj->ij", (30, 3), (3, 20))
    counts = X.key_counts(p, x, y)
    hot = counts.where(F.col("na") * F.col("nb") > 16)
    rows = X.join_agg(p, x, y, hot=hot)
    close(to_numpy(X.complete(p, rows, 1, 0, None, (), True)), a @ b)
    left, right = X.split_hot(*X.operands(p, x, y), hot)
    assert left.count() == 90 * 5 and right.count() == 60 * 8
    assert left.groupBy("aj", "ap", "aq").count().agg(F.max("count")).first()[0] <= 10


def test_blocks_stream(spark):
    """Blocks over many contraction blocks, output blocks and batch labels; zero cells are left out of sparse results."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(-3, 4, (3, 7, 11)).astype(float), rng.integers(-3, 4, (3, 11, 9)).astype(float)
    for n in (None, 3):
        got = contract("hik,hkj->hij", from_numpy(spark, a), from_numpy(spark, b), config=PlanConfig(strategy="block_gemm", block_size=4, partitions=n))
        close(to_numpy(got), a @ b)
    x = from_numpy(spark, np.eye(9)).replace(dense=False)
    assert contract("ik,kj->ij", x, x, config=PlanConfig(strategy="block_gemm", block_size=4, density="sparse")).df.count() == 9


def test_ordered_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(X, "ORDERED", 8)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 300)), rng.normal(size=(300, 2))
    bits = set()
    for n in (1, 5):
        c, d = (from_numpy(spark, t) for t in (a, b))
        got = to_numpy(contract("ik,kj->ij", c.replace(df=c.df.repartition(n)), d, config=PlanConfig(deterministic=True)))
        close(got, a @ b)
        bits.add(got.tobytes())
    assert len(bits) == 1


def test_requirements_and_budget(spark):
    p = Problem.einsum("f64", "ik,kj->ij", (2, 3), (3, 4))
    with pytest.raises(E.StrategyRefused):
        SparkBackend(PlanConfig(strategy="block_gemm")).prepare(p, Requirements(no_materialize=True))
    with pytest.raises(E.WouldMaterialize):
        NumpyBackend().prepare(p, Requirements(no_materialize=True))
    prepared = SparkBackend().prepare(p, Requirements(no_materialize=True), PlanningBudget(2))
    assert prepared.plan.config.partitions == 6 and prepared.diagnostics.algorithm == "join_agg.f64" and prepared.diagnostics.materialized == (False,) * 3
    one = small_ints(spark, (2, 3), 1)
    two = small_ints(spark, (3, 4), 2)
    close(to_numpy(prepared.run(one, two)), to_numpy(one) @ to_numpy(two))
    assert PlanningBudget.of(spark).partitions() == 12


def test_bad_rows_are_refused(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 3, 2.0)], "a long, b long, v double")
    for bad in (rows, rows.limit(0).union(spark.createDataFrame([(None, 0, 1.0)], rows.schema)), rows.limit(0).union(spark.createDataFrame([(0, 0, None)], rows.schema))):
        with pytest.raises(Exception, match="BadCoordinate"):
            from_table(bad, ["a", "b"], "v", (1, 2)).df.collect()
        assert from_table(bad, ["a", "b"], "v", (1, 2), invalid="drop").df.count() <= 1
    with pytest.raises(E.OptionError):
        from_table(rows, ["a"], "v", (1,), invalid="keep")
    flat = spark.createDataFrame([(0, 1.0), (1, 2.0), (3, 4.0)], "pos long, v double")
    with pytest.raises(Exception, match="BadCoordinate"):
        from_strided(flat, LayoutSpec((2, 2), (2, 1))).df.collect()


@pytest.mark.parametrize("mask", range(16))
def test_all_conjugations(spark, mask):
    rng = np.random.default_rng(mask)
    a, b, c = arrays(rng, (2, 3), "c64"), arrays(rng, (3, 2), "c64"), arrays(rng, (2, 2), "c64")
    names = "".join(x for i, x in enumerate("abcd") if mask >> i & 1)
    k = lambda x, n: np.conj(x) if n in names else x
    p = Plan(Problem.einsum("c64", "ik,kj->ij", (2, 3), (3, 2), names))
    got = to_numpy(p.execute_accum(*(from_numpy(spark, x) for x in (a, b)), 2 - 1j, 1 + 1j, d_old=from_numpy(spark, c)))
    close(got, k((2 - 1j) * (k(a, "a") @ k(b, "b")) + (1 + 1j) * k(c, "c"), "d"))


def test_dlpack_object(spark):
    class Lent:
        def __init__(self, x):
            self.x = x

        def __dlpack__(self, **kw):
            return self.x.__dlpack__(**kw)

        def __dlpack_device__(self):
            return self.x.__dlpack_device__()

    x = np.arange(6.0).reshape(2, 3)[:, ::-1]
    close(to_numpy(from_numpy(spark, Lent(x))), x)


def test_two_backends_agree(spark):
    rng = np.random.default_rng(9)
    p = Problem.einsum("c64", "abb,bc->ca", (2, 3, 3), (3, 4), "a")
    a, b, c = from_numpy(spark, arrays(rng, (2, 3, 3), "c64")), from_numpy(spark, arrays(rng, (3, 4), "c64")), from_numpy(spark, arrays(rng, (4, 2), "c64"))
    x, y = (to_numpy(k.prepare(p).run(a, b, 2, 1j, c)) for k in (SparkBackend(), NumpyBackend()))
    close(x, y)


def test_tiles_of_ones_own(spark):
    one = from_numpy(spark, np.ones((3, 3)))
    catalog = TileCatalog().union(TileCatalog({"4m": lambda x, y: 2 * (x @ y)}))
    p = Problem.einsum("f64", "ik,kj->ij", (3, 3), (3, 3))
    assert to_numpy(Plan(p, PlanConfig(strategy="block_gemm", block_size=2), catalog=catalog).execute(one, one))[0, 0] == 6


def test_deterministic_sum_has_the_same_bits(spark):
    rng = np.random.default_rng(1)
    a, b = from_numpy(spark, rng.normal(size=(8, 40))), from_numpy(spark, rng.normal(size=(40, 8)))
    bits = set()
    for n in (1, 3, 7):
        c, d = (t.replace(df=t.df.repartition(n)) for t in (a, b))
        bits.add(to_numpy(contract("ik,kj->ij", c, d, config=PlanConfig(deterministic=True))).tobytes())
    assert len(bits) == 1


def test_strides(spark, tmp_path):
    flat = spark.range(12).selectExpr("id AS pos", "cast(id AS double) AS v")
    layout = LayoutSpec((3, 4), (-1, -3), 11)
    t = from_strided(flat, layout)
    assert to_numpy(t).tolist() == [[11 - i - 3 * j for j in range(4)] for i in range(3)]
    assert sorted((r.pos, r.v) for r in to_strided(t, layout).collect()) == [(i, float(i)) for i in range(12)]
    assert to_numpy(from_strided(flat, LayoutSpec((2, 3), (0, 1)))).tolist() == [[0, 1, 2]] * 2
    write_tensor(t, str(tmp_path / "t"))
    saved = spark.read.parquet(str(tmp_path / "t"))
    with pytest.raises(E.OutputOverlapsInput):
        check_sink(str(tmp_path / "t"), [saved])
    check_sink(str(tmp_path / "u"), [saved])


def test_density_check(spark):
    t = small_ints(spark, (2, 3), 1)
    t.check()
    with pytest.raises(E.NotDense):
        Tensor(t.df.where("x0 = 0"), (2, 3), t.dtype, True).check()
    with pytest.raises(E.NotDense):
        Tensor(t.df.unionByName(t.df), (2, 3), t.dtype, False).check()
    with pytest.raises(E.NotAPermutation):
        X.permute(t, (0, 0))
    assert to_numpy(X.permute(t, (1, 0))).shape == (3, 2)


def test_isolated_label_is_summed_before_the_join(spark):
    a, b = small_ints(spark, (3, 4, 50), 1), small_ints(spark, (4, 5), 2)
    plan = contract("ikr,kj->ij", a, b).df._jdf.queryExecution().optimizedPlan().toString()
    join, partial = plan.index("Join"), plan.rindex("Aggregate")
    assert partial > join


def test_stream_accumulates(spark, tmp_path):
    from sparkfold.streaming import accumulate, total

    t = small_ints(spark, (4, 3), 1)
    b = small_ints(spark, (3, 2), 2)
    for i in range(4):
        t.df.where(f"x0 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(t.df.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    plan = Plan(Problem.einsum("f64", "ik,kj->ij", (4, 3), (3, 2)))
    q = accumulate(stream, plan, b, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = total(spark.read.parquet(str(tmp_path / "out")), 2)
    want = to_numpy(t) @ to_numpy(b)
    assert {(r.x0, r.x1): r.v for r in got.collect()} == {(i, j): want[i, j] for i in range(4) for j in range(2) if want[i, j]}
