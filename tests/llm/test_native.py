"""Mixing and line de-duplication: against SQL, brute force, and on awkward tables."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkfold.llm import common, line_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op1_mixing", "op9_line_dedup"])
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r[x] for x in cols) for r in got.collect()) == sorted(tuple(r) for r in cur.fetchall())


def brute_lines(rows):
    keys = {}
    last = 2**63 - 1
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            keys.setdefault(key(x), set()).add(last if i is None else i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and min(keys[key(x)]) < (last if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


AWKWARD = [
    (5, "a long enough line\nunique to five here\n", "a"), (3, "A LONG enough line \nshort\nshort", "a"), (9, None, None), (None, "a long enough line\nnull id line here", "b"),
    (7, "", "b"), (5, "a long enough line\nunique to five here\n", "a"), (8, "\t a long enough line", "b"), (10, "é" * 9 + "\n" + "é" * 10, "c"), (11, "é" * 9 + "\n" + "é" * 10 + "\n\n", "c"),
    (12, "\n".join(f"line number {i % 50} of many" for i in range(400)), "c"), (13, "line number 7 of many\nlast", "c"),
]


def test_line_dedup_awkward(spark):
    got = line_dedup.dedup_lines(frame(spark, AWKWARD).withColumn("pos", F.lit(1)).withColumn("h1", F.lit("x")), batches=3)
    assert {"pos", "h1"} <= set(got.columns)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute_lines(AWKWARD)


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_runs_are_merged(spark):
    store = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for i in range(5):
        fresh = store.ingest(spark.range(i, i + 10).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(i).cast("long").alias("owner")))
        assert fresh.count() == (10 if i == 0 else 1)
    assert len(store.runs()) == 2 and [len(x) for x in store.levels] == [1, 0, 1]
    assert sum(spark.table(r).count() for r in store.runs()) == 14
    store.forget()


def test_runs_go_on_in_later_calls(spark):
    """Two halves, the second from the loaded manifest, drop the same lines as one call; nothing is left behind."""
    rows = [(i, f"line number {i % 7} of this text\nand one of its own: {i}\nshort", "a") for i in range(40)]
    cols = lambda df: sorted((r.doc_id, r.n_dropped, r.kept_text) for r in df.collect())
    tables = len(spark.catalog.listTables())
    want = cols(line_dedup.dedup_lines(frame(spark, rows), batches=2))
    assert len(spark.catalog.listTables()) == tables
    store = line_dedup.LineRuns(spark, buckets=3)
    first = cols(line_dedup.dedup_lines(frame(spark, rows[:25]), batches=2, runs=store))
    again = line_dedup.LineRuns.load(spark, store.manifest())
    store.forget()
    assert first + cols(line_dedup.dedup_lines(frame(spark, rows[25:]), batches=2, runs=again)) == want
    again.forget()


def test_scratch_tables_are_deleted(spark):
    start = common.mark()
    df, path = common.stored_at(spark.range(3).toDF("id"), "one")
    other, gone = common.stored_at(spark.range(3).toDF("id"), "two")
    common.discard(spark, start, [path])
    assert df.count() == 3 and os.path.exists(path.removeprefix("file://")) and not os.path.exists(gone.removeprefix("file://"))


def test_join_hot_is_a_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.where("k <> 7").groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("top"))
    got = common.join_hot(left, right, ["k"], "rows", 3000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_anti_join_of_runs_moves_no_run(spark):
    store = line_dedup.LineRuns(spark, buckets=4)
    rows = spark.range(100).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("owner"))
    store.ingest(rows)
    new = rows.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
    joined = new.join(spark.table(store.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    store.forget()


def test_mix_awkward(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(200)] + [(None, "x y", None), (500, None, "a"), (3, "w w w", "a"), (3, "w w w", "a")]
    got = mixing.mix(frame(spark, rows).withColumn("u", F.lit(0)).withColumn("p", F.lit(0)).withColumn("size", F.lit(-1))).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    assert total == sum(len((t or "").split()) for _, t, _ in rows)
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3
        x = by.setdefault(r.source, [r.target, r.source_size, 0, 0])
        x[2] += r.copies * r["size"]
        x[3] = max(x[3], r["size"])
    assert abs(sum(x[0] for x in by.values()) - total) < 1e-6
    for target, size, taken, longest in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 2 * longest
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_short_documents_are_likelier(spark):
    """Inclusion probabilities differ inside a source: extra copies go to short documents more often, by the odds' tilt."""
    rows = [(i, "w " * (10 if i % 2 else 160), "a") for i in range(4000)] + [(9000 + i, "w " * 400, s) for i, s in enumerate("bcdefg" * 50)]
    got = mixing.mix(frame(spark, rows)).where("source = 'a'").groupBy("size").agg(F.avg("copies"), F.first(F.col("target") / F.col("source_size"))).collect()
    (_, long, ratio), (_, short, _) = sorted(map(tuple, got), reverse=True)
    certain = int(ratio)
    assert long - certain < ratio - certain < short - certain < 1
    odds = lambda p: p / (1 - p)
    assert 2.5 < odds(short - certain) / odds(long - certain) < 6.5


def test_mix_of_a_very_long_document(spark):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(100)] + [(1000, "w " * 300_000, "a")]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert got[1000]["size"] == 300_000 and 0 <= got[1000].copies <= 3 and sum(r["size"] for r in got.values()) == 305_000


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    (r,) = mixing.mix(frame(spark, [(1, "  ", "a")])).collect()
    assert (r["size"], r.target, r.copies) == (0, 0.0, 0)


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", "a", 100), ("b", "b", 10), ("c", "c", 1000), ("n", None, 10)], "_mx_key string, source string, source_size long")
    got = {r._mx_key: r.target for r in mixing.allocate(sizes).collect()}
    # 1120 to share by 5, 2, 1, 5: a, b and the null source stop at three times their size.
    assert got["a"] == 300 and got["b"] == 30 and got["n"] == 30 and abs(got["c"] - 760) < 1e-9


def test_kept_hash(spark, sf):
    r = entry.queries()["op9_line_dedup"](spark, sf).where("n_dropped = 0").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").first()
    assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
