"""Line de-duplication over levelled sorted runs of line hashes (DataFrame operations only).

Documents arrive in batches of ascending id. A batch reduces its lines to one row per key (128-bit hash, smallest
document), anti-joins that against every run written before, and what is left becomes a new sorted run: the keys
first seen in this batch, each with its owner. Runs are tables bucketed and sorted by the hash, so the anti-join is
a merge of sorted buckets without an exchange on the side of the runs. When a level holds ``fanout`` runs they are
merged into one run of the next level, so a batch meets a number of runs logarithmic in the number of batches.

Because batches ascend, the owner in a run is the smallest document holding the key, and a line goes when its
key's owner is another document. Runs may be kept: ``dedup_lines`` goes on from a ``LineRuns`` that earlier calls filled,
whose documents then count as earlier, and ``LineRuns.manifest`` and ``LineRuns.load`` carry it to another session.

Defined results: a null text counts as one empty line and comes back as the empty text; a null id is a document
after all others; rows that repeat an id count as one document, and each keeps its lines; a very long
text or line is handled whole; an empty table gives an empty table. Other columns pass through, whatever their names (inner names start with ``_ld_``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import HOT_SHARE, SPACES, ascii_lower, discard, mark, scratch_dir, stored, stored_at, table

#: Keys shorter than this never count as repeated.
MIN_CHARS = 10
#: Batches a table is cut into, by quantiles of its ids, and runs of one level before they are merged.
BATCHES = 4
FANOUT = 2
LAST_ID = 9223372036854775807


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """The levelled runs. ``ingest`` takes (h1, h2, owner) rows of one batch and returns those first seen in it."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        #: Name -> path of every run's table, those merged into others too.
        self.tables: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name, path = f"sparkfold_run_{uuid.uuid4().hex}", scratch_dir(self.spark, "line-run")
        df.select("h1", "h2", "owner").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.tables[name] = path
        return name

    def manifest(self) -> dict:
        """What ``load`` needs: the paths of the runs by level, buckets and fanout."""
        return {"fanout": self.fanout, "buckets": self.buckets, "levels": [[self.tables[n] for n in level] for level in self.levels]}

    @staticmethod
    def load(spark: SparkSession, manifest: dict) -> LineRuns:
        out = LineRuns(spark, manifest["fanout"], manifest["buckets"])
        for level in manifest["levels"]:
            names = []
            for path in level:
                name = f"sparkfold_run_{uuid.uuid4().hex}"
                spark.sql(
                    f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {out.buckets} BUCKETS LOCATION '{path}'"
                )
                out.tables[name] = path
                names.append(name)
            out.levels.append(names)
        return out

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def ingest(self, firsts: DataFrame) -> DataFrame:
        for name in self.runs():
            firsts = firsts.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        run = self._write(firsts)
        fresh = self.spark.table(run)
        self._push(run, 0)
        return fresh

    def _push(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.spark.table(self.levels[level][0])
            for name in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.levels[level] = []
            self._push(self._write(merged), level + 1)

    def forget(self) -> None:
        """Drops the catalog entries; the files stay until they are discarded, or for ``load``."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batch_of(spark: SparkSession, docs: DataFrame, batches: int) -> Column:
    cuts = docs.agg(F.percentile_approx("_ld_doc", [i / batches for i in range(1, batches)], 10000)).first()[0] or []
    out = F.lit(0)
    for c in sorted(set(cuts)):
        out = out + (F.col("_ld_doc") > c).cast("int")
    return out


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    runs: LineRuns | None = None,
) -> DataFrame:
    """The rows of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` beside the columns they had.

    A column of ``docs`` that has one of these three names is replaced. ``runs``: those of earlier calls, to which this
    call adds its own; without it the call's runs are deleted at its end.
    """
    spark, start = docs.sparkSession, mark()
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    marked = docs.withColumns({
        "_ld_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)),
        "_ld_text": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    })
    ids = marked.select("_ld_doc")
    key = line_key(F.col("line"))
    lines = (
        marked.select("_ld_doc", "_ld_text", F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
        .select("_ld_doc", "_ld_text", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            "_ld_doc", "_ld_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
            _batch_of(spark, ids, batches).alias("batch"),
        )
    )
    lines = stored(lines, "lines")
    held = {r.batch: r["count"] for r in lines.groupBy("batch").count().collect()}

    store = runs if runs is not None else LineRuns(spark, fanout)
    dropped = None
    for b in range(batches):
        mine = lines.where(F.col("batch") == b)
        firsts = stored(mine.groupBy("h1", "h2").agg(F.min("_ld_doc").alias("owner"), F.count("*").alias("n")), "firsts")
        fresh = store.ingest(firsts.drop("n"))
        hot = F.broadcast(firsts.where(F.col("n") > held.get(b, 0) * HOT_SHARE).select("h1", "h2").join(fresh, ["h1", "h2"], "left"))
        for rows, owners in ((mine.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti"), fresh), (mine.join(hot.select("h1", "h2"), ["h1", "h2"], "left_semi"), hot)):
            gone = rows.join(owners, ["h1", "h2"], "left").where(F.col("owner").isNull() | (F.col("owner") < F.col("_ld_doc"))).select("_ld_doc", "_ld_text", "pos")
            dropped = gone if dropped is None else dropped.unionByName(gone)
    positions = dropped.groupBy("_ld_doc", "_ld_text").agg(F.array_sort(F.collect_set("pos")).alias("_ld_gone"))

    positions, path = stored_at(positions, "positions")
    if runs is None:
        store.forget()
    discard(spark, start, [path, *(store.tables.values() if runs is not None else ())])
    joined = marked.join(positions, ["_ld_doc", "_ld_text"], "left")
    # Sorted positions become one flag a line, so that filtering a text is linear in its lines.
    flags = F.flatten(
        F.transform(
            F.col("_ld_gone"),
            lambda p, i: F.concat(
                F.array_repeat(F.lit(False), p - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("_ld_gone"), i - 1)) - 1),
                F.array(F.lit(True)),
            ),
        )
    )
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    out = joined.withColumn("_ld_flags", flags)
    kept = F.when(F.col("_ld_flags").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.filter(split, lambda line, i: ~F.coalesce(F.get(F.col("_ld_flags"), i), F.lit(False))), "\n")
    )
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
