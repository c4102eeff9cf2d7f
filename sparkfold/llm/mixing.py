"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

A source's target over its size is the expected number of copies of each of its words. The whole part is allocated to
every document for certain; of the fraction f documents compete for one more copy. Their inclusion probabilities differ:
the odds of a document are those of f times ``tilt``, the root of its source's mean size over its own (1/4 to 4), so
that short documents come again rather than long ones and a source's extra words are spread over more texts. Documents
are ranked by the odds of a random number over these inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the first of
them are taken up to the words that the source still lacks: a sample of fixed size, in words.

The rank is cut without sorting a source in one task: a histogram of the ranks (``BINS`` bins, summed before the
shuffle) finds the bin in which the source's words run out, and only documents of that bin are ordered. ``u`` comes from
the id's MD5 and the seed, so reruns and other partitionings agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that repeat an id
share their random number, and copies are taken together; a source without words has target 0; an empty table gives an empty
table; columns of any name stay. A very long document competes as one: its source misses the target by half of it at
most. Sources are ordered in one task: their number, unlike the documents', is taken to be some millions at most. The cut is the prefix of the ranking whose words come nearest to the target, the shorter one on a tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfold.llm.common import stored, table, word_count

#: Weights dealt to the sources in code point order, repeating, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MOST = 3
#: The furthest a document's inclusion odds are from its source's, as a factor either way.
TILT = 4.0
SEED = "mix-1"
BINS = 16384
_HEX13 = float(16**13)


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _HEX13


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def allocate(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of the sources. ``sizes``: _mx_key, source, source_size and others; adds target.

    Water filling in closed form: in order of cap over weight, sources are capped while the level that the rest would
    get reaches their cap.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(by_name) - 1) % n).cast("long")
    ranked = sizes.withColumn("weight", weight)
    by_cap = W.orderBy(F.col("source_size") * float(most) / F.col("weight"), "_mx_key")
    before, rest = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("source_size") * float(most) / F.col("weight") > F.col("level"))
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("source_size") * float(most) / F.col("weight"), F.col("_mx_key"), F.col("level")))).over(W.partitionBy())
    return (
        levels.withColumn("first", first_open)
        .withColumn("free", F.col("first").isNotNull() & (F.struct(F.col("source_size") * float(most) / F.col("weight"), F.col("_mx_key")) >= F.struct(F.col("first.col1"), F.col("first._mx_key"))))
        .withColumn("target", F.when(F.col("free"), F.col("weight") * F.col("first.level")).otherwise(F.col("source_size") * float(most)))
        .select(*[c for c in sizes.columns if c != "source"], "target")
    )


def inclusion_odds(fraction: Column, size: Column, mean_size: Column) -> Column:
    """Odds p / (1 - p) of a document's inclusion."""
    tilt = F.least(F.greatest(F.sqrt(mean_size / size), F.lit(1 / TILT)), F.lit(TILT))
    return fraction / (1 - fraction) * tilt


def pareto_rank(u: Column, odds: Column) -> Column:
    return (u / (1 - u)) / odds


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
    bins: int = BINS,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``) beside their columns.

    Columns of ``docs`` that have one of these names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    u = uniform(F.col(id_col), seed)
    slim = stored(
        docs.select(source_key(F.col(source_col)).alias("_mx_key"), F.col(source_col).alias("source"), u.alias("u"), word_count(F.col(text_col)).alias("size")),
        "mix-sizes",
    )
    sizes = slim.groupBy("_mx_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    sizes = sizes.withColumn("mean_size", F.when(F.col("docs") > 0, F.col("source_size").cast("double") / F.col("docs"))).drop("docs")
    targets = stored(allocate(sizes, weights, most).coalesce(1), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("certain", F.floor(ratio)).withColumn("p", ratio - F.col("certain"))
    plan = plan.withColumn("lacks", F.col("target") - F.col("certain") * F.col("source_size"))

    # Ranks of the documents that compete for the fractions; equal random numbers stand or fall together.
    ranks = (
        slim.select("_mx_key", "u", "size").where(F.col("size") > 0)
        .join(plan.where(F.col("p") > 0).select("_mx_key", "p", "mean_size", "lacks"), "_mx_key")
        .withColumn("q", pareto_rank(F.col("u"), inclusion_odds(F.col("p"), F.col("size"), F.col("mean_size"))))
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int"))
    )
    upto = W.partitionBy("_mx_key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cut_bin = (
        ranks.groupBy("_mx_key", "bin").agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"))
        .withColumn("through", F.sum("words").over(upto)).withColumn("base", F.col("through") - F.col("words"))
        .where((F.col("base") <= F.col("lacks")) & (F.col("lacks") < F.col("through")))
        .select("_mx_key", "bin", "base")
    )
    cut_bin = stored(cut_bin.coalesce(1), "mix-bins")
    in_order = W.partitionBy("_mx_key").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    edge = (
        ranks.join(cut_bin, ["_mx_key", "bin"])
        .groupBy("_mx_key", "q", "base", "lacks").agg(F.sum("size").alias("words"))
        .withColumn("through", F.col("base") + F.sum("words").over(in_order))
        .select("_mx_key", "q", F.abs(F.col("through") - F.col("lacks")).alias("off"), "through")
    )
    # Or none of the bin: all ranks below it.
    floor = cut_bin.join(plan.select("_mx_key", "lacks"), "_mx_key").select(
        "_mx_key", F.lit(-1.0).alias("q"), F.abs(F.col("base") - F.col("lacks")).alias("off"), F.col("base").alias("through")
    )
    best = edge.unionByName(floor).groupBy("_mx_key").agg(F.min(F.struct("off", "through", "q")).alias("best"))
    cuts = best.join(cut_bin, "_mx_key").select("_mx_key", F.col("best.q").alias("cut_q"), F.col("bin").alias("cut_bin"))
    # Without a cut bin (all words lacked, to the last) every competing document is in.
    decided = stored(plan.join(cuts, "_mx_key", "left").coalesce(1), "mix-cuts")

    inner = {c: f"_mx_{c}" for c in ("certain", "p", "mean_size", "cut_q", "cut_bin")}
    decided = decided.select("_mx_key", "source_size", "target", *[F.col(c).alias(n) for c, n in inner.items()])
    out = docs.withColumns({"_mx_key": source_key(F.col(source_col)), "_mx_u": u, "size": word_count(F.col(text_col))}).join(decided, "_mx_key")
    q = pareto_rank(F.col("_mx_u"), inclusion_odds(F.col("_mx_p"), F.col("size"), F.col("_mx_mean_size")))
    own_bin = F.floor(q / (1 + q) * bins).cast("int")
    below = (own_bin < F.col("_mx_cut_bin")) | ((own_bin == F.col("_mx_cut_bin")) & (q <= F.col("_mx_cut_q")))
    extra = F.when((F.col("_mx_p") <= 0) | (F.col("size") == 0), F.lit(0)).when(F.col("_mx_cut_bin").isNull() | below, F.lit(1)).otherwise(F.lit(0))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target", (F.col("_mx_certain") + extra).cast("int").alias("copies")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE / nullif(count(*) FILTER (size > 0), 0) AS mean_size FROM d GROUP BY k
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s
), c AS (
  SELECT *, source_size * 3.0::DOUBLE / weight AS cap FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY cap, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER (ORDER BY cap, k) AS n FROM c
), f AS (
  SELECT min(n) AS n FROM l WHERE cap > level
), t AS (
  SELECT l.k, l.source_size, l.mean_size,
         CASE WHEN l.n >= f.n THEN l.weight * (SELECT level FROM l AS l2, f AS f2 WHERE l2.n = f2.n) ELSE l.source_size * 3.0::DOUBLE END AS target
  FROM l, f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM t
), p AS (
  SELECT *, floor(ratio) AS certain, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS lacks FROM r
), o AS (
  SELECT d.*, p.source_size, p.target, p.certain, p.p, p.lacks,
         CASE WHEN d.size > 0 AND p.p > 0 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p) * least(greatest(sqrt(p.mean_size / d.size), 0.25::DOUBLE), 4.0::DOUBLE)) END AS q
  FROM d JOIN p USING (k)
), g AS (
  SELECT k, q, lacks, sum(size) AS words FROM o WHERE q IS NOT NULL GROUP BY k, q, lacks
), h AS (
  SELECT k, q, lacks, sum(words) OVER (PARTITION BY k ORDER BY q) AS through FROM g
), b AS (
  SELECT k, min(struct_pack(off := abs(through - lacks), through := through::DOUBLE, q := q)) AS best
  FROM (SELECT k, q, lacks, through FROM h UNION ALL SELECT k, -1.0, lacks, 0 FROM p) GROUP BY k
)
SELECT o.doc_id, o.size, o.source_size, o.target, ((o.certain + CASE WHEN o.q <= b.best.q THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o JOIN b USING (k)
"""
