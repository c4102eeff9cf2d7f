"""Blocks: every output block in one task, whole and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold import operators as X
from sparkfold.plans import Plan, PlanConfig, contract
from sparkfold.problem import Problem
from sparkfold.sources import from_numpy, from_table, small_ints, to_numpy

BLOCKS = {"strategy": "block_gemm", "density": "sparse"}


def above_blocks(df) -> str:
    """The plan above the last Python node: what happens to the output once it is made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("MapInArrow")]


def random_ints(shape, share, seed, im=False):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(shape) < share, rng.integers(-5, 6, shape), 0).astype(float)
    return x + 1j * np.where(x != 0, rng.integers(-5, 6, shape), 0) if im else x


def sparse(spark, x):
    t = from_numpy(spark, x)
    zero = "v.re = 0 and v.im = 0" if np.iscomplexobj(x) else "v = 0"
    return t.replace(df=t.df.where(f"not ({zero})"), dense=False)


def test_output_is_not_shuffled(spark):
    a, b = small_ints(spark, (60, 9), 1), small_ints(spark, (9, 70), 2)
    got = contract("ik,kj->ij", a, b, config=PlanConfig(**BLOCKS, block_size=10, partitions=3))
    assert "Exchange" not in above_blocks(got.df) and "Aggregate" not in above_blocks(got.df)
    assert np.array_equal(to_numpy(got), to_numpy(a) @ to_numpy(b))


@pytest.mark.parametrize("im", [False, True])
@pytest.mark.parametrize("share", [0.004, 0.3])
def test_cell_by_cell_and_dense_products(spark, im, share):
    a, b = random_ints((90, 200), share, 1, im), random_ints((200, 80), share, 2, im)
    for config in (PlanConfig(**BLOCKS, partitions=1), PlanConfig(**BLOCKS, block_size=32, partitions=2), PlanConfig(**BLOCKS, block_size=64, partitions=40)):
        assert np.array_equal(to_numpy(contract("ik,kj->ij", sparse(spark, a), sparse(spark, b), config=config)), a @ b)


def test_dense_result_of_sparse_operands_needs_no_grid_join(spark):
    a, b = random_ints((50, 20), 0.02, 3), random_ints((20, 40), 0.02, 4)
    for size, parts in ((8, 4), (64, 1), (64, 6)):
        got = contract("ik,kj->ij", sparse(spark, a), sparse(spark, b), config=PlanConfig(strategy="block_gemm", block_size=size, partitions=parts))
        assert got.dense and "Join" not in above_blocks(got.df) and got.df.count() == 2000
        assert np.array_equal(to_numpy(got), a @ b)


@pytest.mark.parametrize("k", [6, 40])
def test_accumulates_in_blocks(spark, k):
    a, b, c = random_ints((50, k), 0.3, 5, True), random_ints((k, 40), 0.3, 6, True), random_ints((50, 40), 0.1, 7, True)
    p = Problem.einsum("c64", "ik,kj->ij", a.shape, b.shape, conj="cd")
    got = Plan(p, PlanConfig(**BLOCKS, block_size=16, partitions=2)).execute_accum(sparse(spark, a), sparse(spark, b), 2, 1, d_old=sparse(spark, c))
    assert "Join" not in above_blocks(got.df)
    assert np.array_equal(to_numpy(got), np.conj(2 * (a @ b) + np.conj(c)))


def test_least_leaves_out_the_rest(spark):
    a = small_ints(spark, (40, 7), 1)
    want = to_numpy(a) @ to_numpy(a).T
    for more in (BLOCKS | {"partitions": 1}, BLOCKS | {"block_size": 3}, {"strategy": "join_agg", "density": "sparse"}):
        got = contract("ik,jk->ij", a, a, config=PlanConfig(**more, least=50.0))
        assert np.array_equal(to_numpy(got), np.where(want >= 50, want, 0)) and got.df.count() == (want >= 50).sum()
    got = contract("ik,jk->ij", a, a, alpha=2, config=PlanConfig(**BLOCKS, partitions=1, least=50.0))
    assert got.df.count() == (2 * want >= 50).sum()


def test_rows_that_repeat_a_coordinate(spark):
    rows = spark.range(900).select((F.col("id") % 30).alias("i"), (F.col("id") % 7).alias("k"), (F.col("id") % 5 - 2).cast("double").alias("x"))
    t = from_table(rows, ["i", "k"], "x", (30, 7))
    x = to_numpy(t)
    for config in (PlanConfig(**BLOCKS, partitions=1), PlanConfig(**BLOCKS, block_size=4), PlanConfig(**BLOCKS, block_size=4, deterministic=True)):
        assert np.array_equal(to_numpy(contract("ik,jk->ij", t, t, config=config)), x @ x.T)


def test_edges_are_bounded(spark):
    wide = Problem.einsum("f64", "uk,vk->uv", (90_000, 120), (90_000, 120))
    deep = Problem.einsum("f64", "sp,tp->st", (60_000, 10**6), (60_000, 10**6))
    assert X.edges_of(wide, None, 24) == (16384, 120) and X.edges_of(deep, None, 24) == (2048, 512)
    assert X.edges_of(deep, 100, 24) == (100, 100)


@pytest.mark.parametrize(("conj", "strategy", "density"), [("cd", "block_gemm", "sparse"), ("acd", "join_agg", "dense")])
def test_a_product_that_c_is_made_of_is_made_once(spark, conj, strategy, density):
    a, b = random_ints((30, 40), 0.2, 8, True), random_ints((40, 20), 0.2, 9, True)
    x, y, config = sparse(spark, a), sparse(spark, b), PlanConfig(strategy=strategy, density=density, block_size=16, partitions=2)
    old = contract("ik,kj->ij", x, y, alpha=3j, conj="ad" if "a" in conj else "", config=config)
    p = Problem.einsum("c64", "ik,kj->ij", a.shape, b.shape, conj=conj)
    got = Plan(p, config).execute_accum(x, y, 2, 0.5j, d_old=old)
    ab = (np.conj(a) if "a" in conj else a) @ b
    c = np.conj(3j * ab) if "a" in conj else 3j * ab
    want = 2 * ab + 0.5j * (np.conj(c) if "c" in conj else c)
    assert np.array_equal(to_numpy(got), np.conj(want) if "d" in conj else want)
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == (3 if strategy == "block_gemm" else 0) and plan.count("Join Inner") == (2 if strategy == "block_gemm" else 1)
    # Other operands, or the same otherwise conjugated, are another product.
    other = contract("ik,kj->ij", x, y, conj="b", config=config)
    want = 2 * ab + 0.5j * np.conj(a @ np.conj(b))
    assert np.array_equal(to_numpy(Plan(p, config).execute_accum(x, y, 2, 0.5j, d_old=other)), np.conj(want))


@pytest.mark.parametrize("im", [False, True])
def test_mirror_images_are_made_of_one_side(spark, im):
    a = random_ints((53, 60), 0.2, 10, im)
    t = sparse(spark, a)
    for density in ("sparse", "dense"):
        got = contract("ik,jk->ji", t, t, config=PlanConfig(strategy="block_gemm", density=density, block_size=16, partitions=3))
        plan = got.df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 2 and plan.count("Join Inner") == 1
        assert np.array_equal(to_numpy(got), a @ a.T) and got.df.count() == (53 * 53 if density == "dense" else np.count_nonzero(a @ a.T))


def test_mirror_images_of_batches_and_several_labels(spark):
    x = random_ints((3, 4, 5, 30), 0.3, 11)
    t = sparse(spark, x)
    got = contract("huvk,hwxk->huvwx", t, t, config=PlanConfig(**BLOCKS, block_size=7, partitions=2))
    assert np.array_equal(to_numpy(got), np.einsum("huvk,hwxk->huvwx", x, x))
    # Crossed labels of A and B are no mirror images.
    y = random_ints((6, 6, 30), 0.3, 12)
    t = sparse(spark, y)
    assert not X.mirrored(Problem.einsum("f64", "uvk,uwk->vw", y.shape, y.shape), t, sparse(spark, y))
    got = contract("uvk,wuk->vw", t, t, config=PlanConfig(**BLOCKS, block_size=8, partitions=2))
    assert np.array_equal(to_numpy(got), np.einsum("uvk,wuk->vw", y, y))


def test_choice_of_a_product_with_itself_needs_no_count_by_key(spark, monkeypatch):
    monkeypatch.setattr(X, "key_counts", lambda *_: pytest.fail("keys counted"))
    rows = spark.range(600 * 600).select((F.col("id") % 600).alias("s"), F.expr("id div 600").alias("p"), F.lit(1.0).alias("v"))
    t = from_table(rows, ["s", "p"], "v", (600, 600))
    p = Plan(Problem.einsum("f64", "sp,tp->st", t.dims, t.dims), PlanConfig(density="sparse"))
    p.count(t, t)
    assert p.algorithm == "block_gemm.f64" and 0 < p.report.join_rows <= 600**3
