"""Helpers that the training-data operators share.

Scratch tables go to the shared folder named by ``spark.checkpoint.dir``; a folder of this machine is taken only where
that setting is empty and the session runs on this machine alone, as in tests. Operators delete the tables that they no
longer need; those that a result still reads stay until ``discard`` is called for them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of every word and key rule here: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch tables written by this process, in order; None where one has been deleted.
_written: list[str | None] = []


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared scratch folder of the cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder for scratch tables")
        root = tempfile.gettempdir() + "/sparkfold-scratch"
    path = f"{root.rstrip('/')}/sparkfold/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored_at(df: DataFrame, what: str, **options: str) -> tuple[DataFrame, str]:
    """Writes a table to shared storage and reads it again: cuts lineage, survives executors, has a known size."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    return stored_at(df, what, **options)[0]


def mark() -> int:
    """A point in time, for ``discard``."""
    return len(_written)


def discard(spark: SparkSession, since: int, keep: Sequence[str] = ()) -> None:
    """Deletes the scratch tables written since the mark but those at ``keep``. Nothing may still read them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for i in range(since, len(_written)):
        path = _written[i]
        if path is not None and path not in keep:
            at = hadoop(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _written[i] = None


#: Keys with more than this part of all rows are joined apart: there are fewer than its inverse.
HOT_SHARE = 1 / 500


def join_hot(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str, total: int) -> DataFrame:
    """Inner join with a side of distinct keys whose column ``rows`` says how many rows of the left side a key has.

    Keys with more than ``HOT_SHARE`` of all ``total`` rows, fewer than 500, are broadcast, so that no task gets all
    rows of one; the rest is joined as usual.
    """
    hot = F.col(rows) > total * HOT_SHARE
    heavy = F.broadcast(right.where(hot))
    light = left.join(F.broadcast(right.where(hot).select(*on)), list(on), "left_anti").join(right.where(~hot), list(on))
    return left.join(heavy, list(on)).unionByName(light)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc32_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def map_rows(df: DataFrame, per_batch, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one Arrow batch to a dict of columns (or None for no rows)."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        import pyarrow as pa

        work = per_batch() if getattr(per_batch, "per_task", False) else per_batch
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(out.values(), arrow, strict=True)],
                        schema=arrow,
                    )
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns what a task's batches took to the machine, since workers live on; does nothing where the C library can't."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch, most_bytes: int = 4 << 20):
    """Cuts a batch into slices of about ``most_bytes``, a row at least, so that long texts don't add up in memory."""
    n = max(1, -(-batch.nbytes // most_bytes))
    step = max(1, -(-batch.num_rows // n))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


#: Rows of an Arrow batch at most: Spark's 10,000 are too many of long texts, in the JVM's direct memory too.
BATCH_ROWS = 1000


def _arrow_schema(spark: SparkSession, schema: str):
    """The schema for pyarrow. The session's Arrow batches are cut to ``BATCH_ROWS`` unless they are smaller."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, BATCH_ROWS)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return pa.schema([pa.field(f.name, f.type) for f in out])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, training: Column | None = None) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, _text, _label): those ids of least checksum, stored.

    The sample is a bounded number of ids, so it may be broadcast to the documents. Checksums above those that the
    sample can need are left out first, so that tasks don't each send ``most`` rows to be merged. Of rows that repeat an
    id, the least text is taken, and the greatest label: a hot id adds one row.
    """
    ids = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    if training is not None:
        ids = ids.where(training)
    ids = ids.groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    rank = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":s")).cast("binary"))
    total = ids.count()
    if total > 2 * most:
        ids = ids.where(rank < int(2**32 * 1.5 * most / total))
    ids = ids.orderBy(rank, "doc_id").limit(most)
    rows = docs.select("doc_id", "_text").join(F.broadcast(ids), "doc_id")
    return stored(rows.groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")), "sample")
