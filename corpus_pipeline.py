"""The corpus pipeline: quality rules, line de-duplication, near de-duplication, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one. All
but the last return the columns of ``documents``. Null ids, null texts, repeated rows and empty tables pass as the
operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm import line_dedup, mixing, near_dedup, prefix_viterbi, quality_forest
from sparkfold.llm.common import discard, mark, stored_at, table, word_count

#: Least similarity of near copies, as a fraction.
SIMILAR = (80, 100)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go."""
    return _documents(quality_forest.judge(docs, table(spark, sf_dir, "labels")).where("kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by an earlier document go, and with them documents of which no word is left."""
    out = line_dedup.dedup_lines(docs).where(word_count(F.col("kept_text")) > 0)
    return _documents(out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id. Similar is 0.8 or more, not op3's 0.85."""
    gone = near_dedup.near_groups(docs, similar=SIMILAR).where(~F.col("kept")).select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    out = mixing.mix(docs)
    return _documents(out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    return prefix_viterbi.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The isolation forest can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on the way, and its input, is deleted once its own result is written."""
    docs, start = table(spark, sf_dir, "documents"), mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = stored_at(docs, f"stage{i}")
            discard(spark, start, [path])
    return docs
