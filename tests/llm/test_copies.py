"""Near-duplicates against all pairs."""

import math
import random

from sparkfold.llm import near_dedup as nd


def brute(rows, similar=(85, 100)):
    part = {i: i for i, _ in rows if i is not None}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    sets = [(i, nd.shingle_set(nd.tokens(t))) for i, t in rows]
    for x, (i, s) in enumerate(sets):
        for j, u in sets[:x]:
            if i is not None and j is not None and s and u and similar[1] * len(s & u) >= similar[0] * len(s | u):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, value int")
    return sorted((tuple(r) for r in nd.near_groups(df).collect()), key=str)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(40)}"
    return " ".join(words)


def test_awkward(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(4, a), (2, a.upper()), (9, a + " more"), (7, None), (8, ""), (1, "  \n"), (5, "few words"), (6, "FEW  words"), (None, a), (3, "other " * 30), (10, "other " * 31), (11, a), (11, "again " * 3)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_families_of_copies(spark, monkeypatch):
    """Chains and stars of copies, some below the threshold; lists count as long from three."""
    rnd = random.Random(4)
    rows, n = [], 0
    shared = [f"s{rnd.randrange(500)}" for _ in range(60)]
    for family in range(3):
        base = [f"w{family}.{rnd.randrange(300)}" for _ in range(rnd.choice((40, 90, 150)))] + shared
        for _ in range(40):
            rows.append((n, edited(rnd, base, rnd.randrange(8))))
            n += 7
        chain = base
        for _ in range(10):
            chain = edited(rnd, chain, 2).split()
            rows.append((n, " ".join(chain)))
            n += 7
    for _ in range(20):
        rows.append((n, " ".join([f"x{rnd.randrange(9999)}" for _ in range(50)] + shared)))
        n += 7
    rnd.shuffle(rows)
    want = brute(rows)
    monkeypatch.setattr(nd, "SHORT", 3)
    assert run(spark, rows) == want


def test_overlap_bound():
    def chance_below(o, k=64, t=0.85):
        return sum(math.comb(k, x) * t**x * (1 - t) ** (k - x) for x in range(o))

    o = nd.least_overlap(64, 0.85)
    assert chance_below(o) <= 1e-9 < chance_below(o + 1)
    assert nd.least_overlap(1, 0.85) == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (200, 100), (7, 7)]
    got = {r.id: r.component for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 50, 200: 50}
