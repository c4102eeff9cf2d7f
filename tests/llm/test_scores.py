"""Toxicity, quality, language model, licenses."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkfold.llm import clause_grammar as g
from sparkfold.llm import license_scan as ls
from sparkfold.llm import maxent_lm as lm
from sparkfold.llm import quality_forest as qf
from sparkfold.llm.common import labelled_sample

LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))


# --- toxicity


LEXICON = g.Lexicon({"idiot": 5.0, "fool": 2.0}, {})


def all_readings(parts, symbols):
    """Every path through the transducers one after another, none composed: (weight, outputs)."""
    readings = [(0.0, tuple(x for x, _ in symbols))]
    for part in parts:
        new = []
        for weight, inputs in readings:
            paths = [(0, weight, ())]
            for x in inputs:
                paths = [(t, w + v, (*said, y)) for s, w, said in paths for t, y, v in part.step(s, x)]
            new += [(w, said) for s, w, said in paths if s not in part.refused]
        readings = new
    return [(w + sum(own for y, (_, own) in zip(said, symbols, strict=True) if y in "IDQA"), "".join(said)) for w, said in readings]


def test_best_reading_against_all_paths():
    words = ["idiot", "fool", "you", "not", "said", "kill", "tree", ","]
    rng = np.random.default_rng(5)
    composed = g.grammar()
    clauses = [rng.choice(words, n) for n in (1, 2, 3, 4, 5, 6, 7) for _ in range(60)]
    differ = 0
    for c in clauses:
        symbols = [LEXICON.symbol(w) for w in c]
        want = max(all_readings(composed.parts, symbols))
        got = composed.best(symbols)
        assert abs(got[0] - want[0]) < 1e-9, c
        assert any(abs(w - got[0]) < 1e-9 and said == got[1] for w, said in all_readings(composed.parts, symbols)), c
        differ += any(s == "I" for s, _ in symbols) != (got[0] > 0)
    assert differ > 20


def test_grammar_matches_clauses():
    composed = g.grammar()

    def m(t, w=None):
        scores, counts = g.match(t, w or LEXICON, composed)
        return [round(x, 6) for x in scores], {n: c for n, c in zip(g.PATTERNS, counts, strict=True) if c}

    assert m("what an idiot") == ([5.0], {"plain": 1})
    assert m("you are an idiot") == ([6.0], {"aimed": 1})
    # A word alone, a denied one and a reported one score nothing; at a distance a negation is read past at a price.
    assert m("idiot") == m(" idiot. ") == m("he is not an idiot") == m("she said the idiot came") == m(None) == m("") == ([], {})
    assert m("tall trees, idiot") == m("no, the idiot came") == m("she said it. the idiot came") == ([5.0], {"plain": 1})
    assert m("not in the idiot") == ([2.0], {"plain": 1})
    assert m("i will kill you") == ([6.0], {"threat": 1}) and m("kill anyone, you") == m("never kill you") == ([], {})
    assert m("trees grow. idiot!") == ([5.0], {"plain": 1}) and m("fool, idiot") == ([7.0], {"plain": 2})
    # Weights reach the score.
    strong = g.Lexicon({"idiot": 20.0}, {})
    assert m("she said the idiot came", strong)[0] == [14.0] and m("not idiot trees", strong)[0] == [11.0]


def test_patterns_change_verdicts(spark):
    weights = np.array([-3.0, 2.0, 2.0, 0.0])
    d = docs(spark, [(1, "what an idiot"), (2, "idiot"), (3, "he is not an idiot"), (4, "they said an idiot came"), (5, "i will kill you"), (6, "nobody kill trees"), (7, "what an idiot " * 20_000)])
    got = {r.doc_id: r.predicted for r in g.score(d.withColumn("plain", F.lit(1)), LEXICON, weights).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1}


def test_toxicity_learns_words_and_stems(spark):
    bad = ["zorgle", "quexabc", "quexdef", "quexghi", "quexjkl"]
    rows = [(i, f"plain words number {i % 9} here and " + (bad[i % 5] + " there" if i % 4 == 0 else "more there")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], LABELS)
    d = docs(spark, [*rows, (1000, None), (1001, ""), (None, "a zorgle"), (1002, "so many quexnew " * 3), (1002, "so many quexnew " * 3)])
    lexicon, weights = g.learn(d, labels)
    assert any(x.startswith("quex") or x == "que" for x in lexicon.stems)
    got = {r.doc_id: r for r in g.score(d, lexicon, weights).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert got[1000].score == got[1001].score < 0.3 and got[1002].predicted == 1 and 0 <= got[None].score <= 1


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "you stupid idiot"), (2, "fine weather")])
    got = {r.doc_id: r.predicted for r in g.score(d, *g.learn(d, spark.createDataFrame([], LABELS))).collect()}
    assert got == {1: 1, 2: 0}
    empty = d.limit(0)
    assert g.score(empty, *g.learn(empty, spark.createDataFrame([], LABELS))).collect() == []


def test_held_out_labels_are_not_read(spark):
    rows = [(i, f"text {i} with " + ("zorgle" if i % 2 else "words")) for i in range(200)]
    d = docs(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], LABELS)
    two = spark.createDataFrame([(i, 1, 1 - i % 2 if held(i) else i % 2) for i in range(200)], LABELS)
    a, b = (g.score(d, *g.learn(d, x)).select("doc_id", F.col("score")).collect() for x in (one, two))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# --- quality


def brute_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_base_counts():
    for t in (None, "", " \n\t", "a b c a b c", "x", "é é é é", "l\nl\n\n l\nl", "a|b <c> #d\x0b\x0ce", " nb sp", "w " * 500, "a b a b a b c d e f c d e"):
        assert qf.statistics(t)[0] == brute_counts(t), t


def test_base_counts_with_many_words():
    codes = np.arange(12) % 4
    assert len(np.unique(qf._ranked(codes))) == 4


def test_forest_rejects_junk_and_keeps_the_rest(spark):
    rnd = np.random.default_rng(0)
    word = lambda: "".join(rnd.choice(list("aeioulnrst"), rnd.integers(2, 9)))
    good = [(i, " ".join(word() for _ in range(80)) + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "$$$" for _ in range(80))) for i in range(30)]
    d = spark.createDataFrame([*good, *junk, (2000, None), (2001, "too short")], "doc_id long, text string").withColumn("kept", F.lit(5))
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in [*good, *junk] if i % 2], LABELS)
    got = {r.doc_id: r.kept for r in qf.judge(d, labels).collect()}
    assert sum(not got[i] for i, _ in good) <= 3 and not any(got[i] for i, _ in junk)
    assert not got[2000] and not got[2001]
    bare = {r.doc_id: r.kept for r in qf.judge(d, labels.limit(0)).collect()}
    assert bare[0] and bare[1000] and not bare[2000]
    assert qf.judge(d.limit(0), labels).collect() == []


def test_forest_scores_are_mean_paths():
    """Against a plain walk down every tree, and anomalies come out above the rest."""
    rng = np.random.default_rng(2)
    rows = np.abs(np.r_[rng.normal(0.5, 0.05, (300, 10)), rng.normal(5, 0.1, (3, 10))])
    good = np.arange(303) < 300
    f = qf.Forest(rows, good, trees=20, subsample=64)
    x = rows / f.spread

    def walk(tree, v):
        feature, cut, child, length = tree
        i = 0
        while child[i][0] != i:
            i = child[i][int(v[feature[i]] > cut[i])]
        return length[i]

    want = [2 ** (-np.mean([walk(t, v) for t in f.trees]) / f.norm) for v in x]
    got = f.score(rows)
    assert np.allclose(got, want) and got[300:].min() > np.quantile(got[:300], 0.95)


def test_threshold_is_calibrated_on_rows_the_trees_have_not_seen(spark):
    """Half of the sample grows the trees: with labels of one half only, nothing but the base rule rejects."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 300}" for k in range(60))) for i in range(400)]
    half = {i for i in range(400) if zlib.crc32(f"{i}:half".encode()) % 2 == 0}
    d = docs(spark, rows)
    for part in (half, set(range(400)) - half):
        forest, threshold = qf.fit(d, spark.createDataFrame([(i, i % 3 and 1, 0) for i in part], LABELS))
        assert forest is None and threshold == math.inf
    assert qf.fit(d, spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(400)], LABELS))[0] is not None


def test_sample_takes_a_repeated_id_once(spark):
    d = spark.createDataFrame([(1, t) for t in "dcba"] + [(2, "x")], "doc_id long, _text string")
    got = sorted(map(tuple, labelled_sample(d, spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0)], LABELS), "quality", 10).collect()))
    assert got == [(1, 1, "a"), (2, 0, "x")]


def test_judging_awkward_rows(spark):
    """Repeated rows are judged alike, a long text is counted whole."""
    long = "alpha beta gamma delta\n" * 50_000
    rows = [(1, "a b c " * 30), (1, "a b c " * 30), (2, long)]
    got = qf.judge(docs(spark, rows).withColumn("n_words", F.lit(-1)), spark.createDataFrame([], LABELS)).collect()
    assert [r.n_words for r in got if r.doc_id == 1] == [90, 90] and next(r for r in got if r.doc_id == 2).n_dup_lines == 49_999


# --- language model


def tiny_model(spark, texts):
    classes = lm.Classes([b"the", b"of"], [b"ing", b"ion"])
    vocabulary = lm.Vocabulary(classes, {b"the": 5, b"of": 3, lm.END: 2})
    flat, at, stops = lm.numbered(vocabulary, texts)
    return classes, vocabulary, flat, at, stops


def test_model_is_a_distribution_over_named_features(spark):
    """Every factor is a softmax of the sum of the rows that the words before name."""
    w = [np.random.default_rng(0).normal(size=x.shape).astype(np.float32) for x in lm.start_weights(np.ones((lm.CLASSES, lm.GROUPS)))]
    _, v, flat, at, stops = tiny_model(spark, ["the thing of motion notion", None, "", "of of of"])
    assert list(stops) == [6, 7, 8, 12]
    assert [v.tokens[i] for i in flat[at]] == [*b"the thing of motion notion".split(), *[lm.END] * 3, *[b"of"] * 3, lm.END]
    rows = lm.feature_rows(v.name[flat], v.klass[flat], at)
    for x, got, first, part in zip(w, lm.both(w, rows, len(at)), lm.FIRST, rows, strict=True):
        for t in range(len(at)):
            s = sum(x[first[i] + (0 if r is None else int(r[t]))].astype(float) for i, r in enumerate(part))
            assert np.allclose(got[t], np.exp(s) / np.exp(s).sum(), atol=1e-5)
    assert v.name[flat][at[1]] != v.name[flat][at[3]] and v.klass[v[b"motion"]] == v.klass[v[b"notion"]]


def test_a_round_is_the_gradient_of_the_likelihood(spark):
    """Observed less expected counts equal the numerical derivative of the log-likelihood."""
    _, v, flat, at, _ = tiny_model(spark, ["the thing of motion and the notion of being", "of the ring"])
    names, kinds, groups = v.name[flat], v.klass[flat], v.group[flat]
    k, g = kinds[at].astype(int), groups[at].astype(int)
    rows = lm.feature_rows(names, kinds, at)
    w = [np.random.default_rng(1).normal(size=x.shape).astype(np.float32) / 4 for x in lm.start_weights(np.ones((lm.CLASSES, lm.GROUPS)))]
    every = np.arange(len(at))
    for factor, target in enumerate((k, g)):
        sums = lm.Sums(factor)
        sums.add(lm.both(w, rows, len(at))[factor], rows[factor], target)
        likelihood = lambda: np.log(lm.both(w, rows, len(at))[factor][every, target].astype(float)).sum()  # noqa: B023, E731
        for region in range(len(rows[factor])):
            r = rows[factor][region]
            row = lm.FIRST[factor][region] + (0 if r is None else int(r[2]))
            for o in (int(target[2]), 3):
                kept = w[factor][row, o]
                w[factor][row, o] = kept + 0.05
                up = likelihood()
                w[factor][row, o] = kept - 0.05
                down = likelihood()
                w[factor][row, o] = kept
                assert abs((up - down) / 0.1 - sums.gap[o, row] / lm.UNIT) < 5e-3
        assert sums.seen[:, : lm.FIRST[factor][1]].sum() == len(at)


def test_scores_do_not_depend_on_the_partitioning(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, seven = (sorted((r.doc_id, r.score) for r in lm.score_texts(x).collect()) for x in (d.repartition(1), d.repartition(7, "text")))
    assert one == seven


def test_head_where_tokens_tie(spark):
    ties = spark.range(20000).select(F.col("id").cast("string").cast("binary").alias("token"), F.lit(1).cast("long").alias("n"))
    assert 500 < len(lm.head_of(ties, 1000)) <= 1000
    some = ties.limit(300).union(spark.createDataFrame([(b"x", 50), (b"y", 50), (b"z", 9)], "token binary, n long"))
    assert list(lm.head_of(some, 1000))[:3] == [b"x", b"y", b"z"] and len(lm.head_of(some, 1000)) == 303
    assert list(lm.head_of(some, 3))[:2] == [b"x", b"y"] and lm.head_of(ties.limit(0), 10) == {}


def test_scores_of_awkward_rows(spark):
    """Repeated rows score alike, a long text is scored whole, and clashing columns are left alone."""
    long = "one two three " * 40_000
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, long), (None, None), (3, "")] + [(i, "a b c d e f") for i in range(10, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("row", "token", "n", "h", "held_out", "score")})
    got = lm.score_texts(d).collect()
    assert len(got) == len(rows) and len({(r.score, r.base_score) for r in got if r.doc_id == 1}) == 1
    assert next(r.n_tokens for r in got if r.doc_id == 2) == 120_001


def test_base_scores_are_exact_and_the_model_better(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 200)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "the the")], "doc_id long, text string"))
    rows = d.collect()
    toks = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in rows}
    key = lambda i: "" if i is None else str(i)
    counts = Counter(w for i, ws in toks.items() if zlib.crc32(key(i).encode()) % 5 != 1 for w in ws)
    n, v = counts.total(), len(counts)
    got = lm.score_texts(d).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[r.doc_id])
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.train_tokens == n
        assert r.n_tokens == len(toks[r.doc_id]) and r.n_known == sum(counts[w] > 0 for w in toks[r.doc_id])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_texts(d.limit(0)).collect() == []


# --- licenses


def test_licenses(spark):
    files = [
        (1, "a/b/LICENSE", "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (2, "a/b/c/d.txt", "nothing here"), (3, "a/x.txt", "nothing"), (4, "a/b/c/e.txt", "some text of its own that is longer than the line below it\nLicensed under CC BY-NC 4.0."),
        (5, "COPYING", "Licensed under the Apache License, Version 2.0."), (6, None, None), (7, "a/b/f.txt", "a license to kill is not a license"), (8, "q/r/s.txt", ""),
    ]
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {i: got[i].own_license for i in (1, 4, 5, 7)} == {1: "MIT", 4: "CC-BY-NC-4.0", 5: "Apache-2.0", 7: None}
    assert (got[2].license, got[2].from_dir) == ("MIT", "a/b") and got[7].license == "MIT"
    assert (got[3].license, got[3].from_dir) == ("Apache-2.0", "") and got[8].license == "Apache-2.0"
    assert got[4].license == "CC-BY-NC-4.0" and not got[4].licence_file and got[6].license is None
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


def test_license_weights_are_the_corpus_own(spark):
    """A header with words that every file has is found whatever the number of files."""
    rest = "by our project team for all of you and them"
    for n in (40, 4000):
        files = [(i, f"d/{i}.txt", rest) for i in range(n)] + [(n, "d/x.txt", "Licensed under the MIT License by our project team for all of you")]
        got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
        assert got[n].own_license == "MIT" and got[0].own_license is None


def test_license_headers_and_texts_over_lines(spark):
    gnu = (
        "/* frob.c: frobs\n * Copyright (C) 2020 Some Body\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n */\nint frob() {{ return 1; }}\n"
    )
    isc = (
        "Copyright (c) 2020, Some Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
        'copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\n'
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR\nANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES\nWHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.\n"
    )
    bsd = ls.TEXTS["BSD-2-Clause"][0].replace(", ", ",\n").replace("reserved. ", "reserved.\n\n")
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + "The licenses for most software are designed to take away your freedom.\n" * 20
    files = [(1, "a/x.c", gnu.format(3)), (2, "a/y.c", gnu.format(2)), (3, "i/LICENSE", isc), (4, "i/src/z.c", "int z;"), (5, "b/LICENSE", bsd), (6, "g/COPYING", gpl)]
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "GPL-3.0", 2: "GPL-2.0", 3: "ISC", 4: "ISC", 5: "BSD-2-Clause", 6: "GPL-2.0"}
    assert got[3].licence_file and got[6].licence_file and not got[4].licence_file


def brute_best(text, corpus, templates):
    """Every segment against every template with dense TF-IDF vectors over all words: the greatest cosine not spoken against."""
    files = [ls.segment_words(t or "") for t in corpus]
    frequency = Counter(w for f in files for w in set(f))

    def vector(words):
        return {w: n * (math.log((1 + len(files)) / (1 + frequency[w])) + 1) for w, n in Counter(words).items()}

    def cosine(x, y):
        return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    blocks = [b.strip("\n") for b in __import__("re").split(r"\n\s*\n", text)]
    segments = [(text, True)] + [(s, False) for b in blocks for s in [b, *b.split("\n"), *__import__("re").split(r"(?<=[.!?])\s+", b)]]
    segments += [(s, False) for line in text.split("\n") for s in __import__("re").split(r"(?<=[.!?])\s+", line)]
    found = []
    for s, whole in segments:
        words = ls.segment_words(s)
        for name, texts in templates.items():
            for t in texts:
                tw = ls.segment_words(t)
                if words and not ls.speaks_against(ls.decisive(tw), ls.decisive(words), whole):
                    found.append((whole, cosine(vector(words), vector(tw)), name))
    top = [x for x in found if x[1] >= ls.SIMILAR]
    return max(top, default=(False, 0.0, None))


def test_licenses_against_brute_force(spark):
    """No segment is left out by the bound: every file gets the license of its best segment."""
    rng = np.random.default_rng(6)
    filler = "this text the of and software files under terms use copy any in to is by for with".split()
    lines = [t for texts in ls._all_templates().values() for t in texts if len(t) < 300]
    corpus = []
    for i in range(120):
        words = [str(rng.choice(filler)) for _ in range(int(rng.integers(5, 60)))]
        body = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        for _ in range(int(rng.integers(0, 3))):
            t = str(rng.choice(lines)).split()
            t = [w for w in t if rng.random() > 0.08] + [str(rng.choice(filler)) for _ in range(int(rng.integers(0, 3)))]
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = ["", " ".join(t), ""] if i % 2 else [" ".join(t[: len(t) // 2]), " ".join(t[len(t) // 2 :])]
        corpus.append("\n".join(body))
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, t in enumerate(corpus)], "doc_id long, path string, text string")).collect()}
    templates, some = ls._all_templates(), 0
    for i, t in enumerate(corpus):
        whole, cosine, name = brute_best(t, corpus, templates)
        assert (got[i].own_license is None) == (name is None) and abs(got[i].cosine - cosine) < 1e-9, (i, t, name, cosine, got[i])
        some += name is not None
    assert 30 < some < 110


def test_versions_and_variants_decide(spark):
    cases = {
        "Licensed under the GNU GPL version 2": "GPL-2.0", "GNU GPL version 2": "GPL-2.0", "GNU GPL version 3": "GPL-3.0", "BSD License": None, "Licensed under the GNU GPL": None,
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: Zlib": None,
        "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licensed under the BSD 2-Clause License": "BSD-2-Clause", "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
        "Licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    }
    noise = [(1000 + i, f"n/{i}.txt", f"other words of a file number {i} the and by under public general work") for i in range(300)]
    files = [(i, f"d{i}/x.txt", t) for i, t in enumerate(cases)] + noise
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumns({c: F.lit("x") for c in ("row", "dir", "word", "rows", "license")})
    got = {r.doc_id: r.license for r in ls.scan_licenses(df).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases and not any(got[i] for i, _, _ in noise)


def test_licenses_of_hot_directories_long_texts_and_repeats(spark):
    files = [(0, "LICENSE", "Released under the MIT License"), *[(i, f"big/{i}.txt", "words of a text") for i in range(1, 400)], (900, None, "words"), (900, None, "words"), (901, "big/long.txt", "some words more\n" * 50_000 + "Licensed under CC BY 4.0")]
    got = {r.doc_id: (r.license, r.from_dir) for r in ls.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert len(got) == 402 and all(got[i] == ("MIT", "") for i in range(1, 400)) and got[900] == (None, None) and got[901][0] == "CC-BY-4.0"
