"""Accumulation over a stream: D += A_delta B for every micro-batch of A (beta = 1 with C = D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.plans import Plan
from sparkfold.sources import Tensor, axis


def increments(plan: Plan, b: Tensor, delta: DataFrame) -> Tensor:
    """The product of a batch of A's cells (sparse) with B."""
    a = Tensor(delta, plan.problem.a.dims, plan.problem.dtype, False)
    return plan.execute(a, b)


def accumulate(stream: DataFrame, plan: Plan, b: Tensor, path: str, checkpoint: str):
    """Starts a query that appends each batch's increments under its id; a batch run again replaces its own."""

    def step(delta: DataFrame, batch: int) -> None:
        increments(plan, b, delta).df.where(F.col("v") != 0).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def total(increments_: DataFrame, rank: int) -> DataFrame:
    """D from the increments so far."""
    return increments_.groupBy(*[axis(i) for i in range(rank)]).agg(F.sum("v").alias("v"))
