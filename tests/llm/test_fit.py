"""The quality forest learns from all labelled rows, the language model from all training texts in every round."""

import zlib

import numpy as np

from sparkfold.llm import maxent_lm as lm
from sparkfold.llm import quality_forest as Q


def test_fit_reads_all_labelled_rows(spark):
    good = " ".join(f"word{i} of text" for i in range(40))
    n = 7000
    rows = [(i, f"{good} {'## ' * 30 if i % 10 == 0 else ''}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(n)], "doc_id long, quality int")
    assert Q._measured(docs, labels, "text").count() == n
    forest, threshold = Q.fit(docs, labels)
    other, same = Q.fit(docs.repartition(7), labels)
    assert threshold == same and len(forest.trees) == Q.TREES
    got = Q.judge(docs, labels).selectExpr("doc_id % 10 != 0 AS good", "kept").groupBy("good", "kept").count().collect()
    assert {(r.good, r.kept): r["count"] for r in got} == {(True, True): 6300, (False, False): 700}


def test_every_round_learns_from_all_training_texts(spark, monkeypatch):
    rows = [(i, f"word{i % 7} of text {i}") for i in range(300)] + [(None, "a b"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sum(zlib.crc32(str("" if i is None else i).encode()) % lm.FOLDS != lm.HELD_OUT for i, _ in rows)
    read, real = [], lm.train_round

    def spy(texts, *args):
        read.append(texts.count())
        return real(texts, *args)

    monkeypatch.setattr(lm, "train_round", spy)
    assert lm.score_texts(docs).count() == len(rows)
    assert len(read) >= lm.ROUNDS and set(read) == {want}


def test_first_sums_are_those_of_all_tokens():
    rnd = np.random.default_rng(3)
    w = lm.start_weights(rnd.uniform(1, 50, (lm.CLASSES, lm.GROUPS)))
    names, kinds, groups = (rnd.integers(0, top, 5004).astype(t) for top, t in ((1 << 32, np.uint32), (lm.CLASSES, np.int64), (lm.GROUPS, np.int64)))
    at = np.arange(4, 5004)
    rows, sums, beginning = lm.feature_rows(names, kinds, at), (lm.Sums(0), lm.Sums(1)), lm.Beginning(w)
    for x, p, r, target in zip(sums, lm.both(w, rows, len(at)), rows, (kinds, groups), strict=True):
        x.add(p, r, target[at])
    beginning.add(rows, kinds[at], groups[at])
    for x, y in zip(sums, beginning.end(), strict=True):
        assert (x.seen == y.seen).all() and (x.expected == y.expected).all() and x.gap.any()
