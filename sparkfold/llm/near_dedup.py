"""MinHash near-duplicate groups with bottom-k sketches from one hash function.

1. Every text becomes its set of 5-word shingles, hashed once; the ``K`` least values are its sketch. Texts with equal
   sets form a class, and only the class's least id goes on.
2. Inverted lists of retained values. Two sets at the threshold share at least ``o`` of their retained values (all but
   one pair in 10^9, see ``least_overlap``; exactly so for small sets), so it is enough to list each class under its
   ``K - o + 1`` rarest values. Values of one class only are counted, then dropped, which ends most classes here.
3. Classes of short lists are paired. A long list (copies by the thousand) is never paired out: its members are
   compared with a hub. Those linked with it are one component. For the rest, shared full shingles are counted: with
   a of A's and b of B's shingles held by any other member at all, a link needs min(a, b) >= t / (1 + t) * (|A| + |B|).
   With x and y their differences from the hub (shingles gained and lost) and p and q those of x and y that another
   member may share, it needs 2 * min(p, q) >= |x| + |y| - (1 - t) / (1 + t) * (|A| + |B|); and Jaccard distances to
   the hub may differ by 1 - t at most. Only pairs that pass are looked at. All three rules are exact, so no link is
   lost and a group's n * n pairs are not made.
4. The union sketch of a pair estimates its similarity and filters; the shingles of the texts themselves confirm it.
5. Confirmed links become components by alternating large and small stars.

Defined results: a text without words (or null) has no shingles and is linked with nothing; fewer than five words make
one shingle; rows with a null id are linked with nothing, have a null component and are kept; rows that repeat an id
count as one document; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import discard, join_hot, map_rows, mark, stored, stored_at, table

WORDS = 5
#: Least similarity, as a fraction.
SIMILAR = (85, 100)
K = 64
MISS = 1e-9
#: Lists up to this many classes are paired outright.
SHORT = 24
ROUNDS = 3
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def least_overlap(k: int, similar: float, miss: float = MISS) -> int:
    """Retained values that two sets of this similarity share, but for a chance of ``miss``: a binomial tail."""
    total = 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * similar**x * (1 - similar) ** (k - x)
        if total > miss:
            return x
    return k


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], cache: _Hashes, size: int = WORDS) -> np.ndarray:
    """The set of hashed shingles, sorted."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ codes[i : n - width + 1 + i]) * _M1
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * _M2
        h = (h ^ (h >> np.uint64(27))) * _M3
    return np.unique(h ^ (h >> np.uint64(31)))


def shingle_set(words: list[bytes], size: int = WORDS) -> set:
    """The shingles themselves, for the exact check."""
    if not words:
        return set()
    n = max(1, len(words) - size + 1)
    return set(zip(*[words[i : i + n] for i in range(size)], strict=False)) if len(words) >= size else {tuple(words)}


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    cache = _Hashes()

    def per_batch(batch):
        import xxhash

        n, one, two, least = [], [], [], []
        for t in batch[text_col].to_pylist():
            h = shingle_hashes(tokens(t), cache)
            d = xxhash.xxh3_128_intdigest(h.tobytes())
            n.append(len(h))
            one.append((d >> 64) - (1 << 63))
            two.append((d & (1 << 64) - 1) - (1 << 63))
            least.append(h[:k].view(np.int64))
        return {"doc_id": batch[id_col], "n": n, "h1": one, "h2": two, "sketch": least}

    return map_rows(docs.select(id_col, text_col), per_batch, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def _index(reps: DataFrame, k: int, similar: float) -> DataFrame:
    """(value, id, alone): the inverted lists of two classes and more, each class under its rarest values."""
    o = least_overlap(k, similar)
    posts = reps.select("id", "n", F.explode("sketch").alias("value"))
    counts = posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(counts, "value").groupBy("id", "n").agg(F.collect_list(F.struct("df", "value")).alias("found"))
    size = F.least(F.col("n"), F.lit(k)).cast("int")
    # A set of at most similar * k has partners of at most k: their sketches are whole, and so is the bound.
    needed = F.when(F.col("n") <= math.floor(similar * k), F.ceil(F.col("n") * F.lit(similar) - 1e-9).cast("int")).otherwise(F.lit(o))
    alone = size - F.size("found")
    listed = F.greatest(size - needed + 1 - alone, F.lit(0))
    return shared.select("id", alone.alias("alone"), F.explode(F.slice(F.array_sort("found"), F.lit(1), listed)).alias("x")).select(
        F.col("x.value").alias("value"), "id", "alone"
    )


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, similar: float) -> DataFrame:
    """Pairs whose size and union sketch leave the threshold possible."""
    o = least_overlap(k, similar)
    a = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where((F.col("na") >= F.col("nb") * similar) & (F.col("nb") >= F.col("na") * similar))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    whole = F.greatest("na", "nb") <= k
    possible = F.when(whole, F.size(F.array_intersect("sa", "sb")) >= similar * F.size(F.array_union("sa", "sb")) - 1e-9).otherwise(common >= o)
    return both.where(possible).select("a", "b")


def _similarity(pairs: DataFrame, texts: DataFrame, where_similar: tuple[int, int] | None) -> DataFrame:
    """(a, b, common, joint, na, nb) of pairs from the shingles of their texts; with a threshold, links only."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def per_batch(batch):
        out: dict[str, list] = {c: [] for c in ("a", "b", "common", "joint", "na", "nb")}
        last, last_set = None, set()
        for x, y, tx, ty in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
            if (x, tx) != last:
                last, last_set = (x, tx), shingle_set(tokens(tx))
            other = shingle_set(tokens(ty))
            common = len(last_set & other)
            joint = len(last_set) + len(other) - common
            if where_similar is None or (joint and where_similar[1] * common >= where_similar[0] * joint):
                for c, v in zip(out, (x, y, common, joint, len(last_set), len(other)), strict=True):
                    out[c].append(v)
        return out

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return map_rows(joined, per_batch, "a long, b long, common long, joint long, na long, nb long")


def _shared_shingles(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, held): how many of a text's shingles some other of these texts holds too."""
    cache = _Hashes()

    def per_batch(batch):
        own, values = [], []
        for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            h = shingle_hashes(tokens(t), cache)
            own.append(np.full(len(h), i, np.int64))
            values.append(h.view(np.int64))
        return {"id": np.concatenate(own), "value": np.concatenate(values)} if own else None

    all_ = map_rows(texts.join(ids, "id", "left_semi").select("id", "text"), per_batch, "id long, value long")
    counts = all_.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    return all_.join(counts, "value").groupBy("id").agg(F.count("*").alias("held"))


def _stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """(u, m, rows) of all u, and how many edges there are."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")), "least")
    return least, least.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all nodes of the links (a, b) but those that are their own component's least.

    A large component's centre has a row for each of its nodes; such centres are joined apart (``join_hot``).
    """
    spark, start = links.sparkSession, mark()
    edges, path = stored_at(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, total = _stars(both)
        large = join_hot(both.where("v > u"), least.select("u", F.least("u", "m").alias("m"), "rows"), ["u"], "rows", total)
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least, total = _stars(large)
        small = join_hot(large, least, ["u"], "rows", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, path = stored_at(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(spark, start, [path])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def _links(reps: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    t = similar[0] / similar[1]
    index = stored(_index(reps, k, t), "index")
    lists = index.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("alone", "id")).alias("hub"))
    lists = stored(lists.where("size > 1").select("value", "size", F.col("hub.id").alias("hub")), "lists")

    short = index.join(lists.where(F.col("size") <= SHORT).select("value"), "value").select("value", "id")
    pairs = short.select("value", F.col("id").alias("a")).join(short.select("value", F.col("id").alias("b")), "value").where("a < b").select("a", "b")
    members = stored(index.join(lists.where(F.col("size") > SHORT), "value").select("hub", "id", "alone").groupBy("hub", "id").agg(F.min("alone").alias("alone")), "members")

    links = [_similarity(stored(_estimated(pairs.distinct(), reps, k, t), "pairs"), texts, similar).select("a", "b")]
    if not members.isEmpty():
        links += _hub_links(members, reps, texts, similar)
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _hub_links(members: DataFrame, reps: DataFrame, texts: DataFrame, similar: tuple[int, int]) -> list[DataFrame]:
    t = similar[0] / similar[1]
    linked = (similar[1] * F.col("common")) >= (similar[0] * F.col("joint"))
    own = stored(texts.join(members.select("id").distinct(), "id", "left_semi"), "texts")
    measured = stored(_similarity(members.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")), own, None), "hubs")
    links = [measured.where(linked).select("a", "b")]
    # (hub, id, far, lost, shared, part): distance to the hub, its shingles lost and kept, and the hub linked with by now.
    far = F.lit(1.0) - F.col("common") / F.col("joint")
    state = measured.groupBy(F.col("a").alias("hub"), F.col("b").alias("id")).agg(
        F.min(far).alias("far"), F.max(F.col("na") - F.col("common")).alias("lost"), F.min("common").alias("shared"), F.min(F.when(linked, F.col("a"))).alias("part")
    ).join(members, ["hub", "id"])
    kept = ("hub", "id", "alone", "far", "lost", "shared")
    state = stored(state.select(*kept, "part"), "state")
    for _ in range(ROUNDS - 1):
        rest = state.where("part is null")
        nexts = rest.groupBy("hub").agg(F.min(F.struct("alone", "id")).alias("x"), F.count("*").alias("left")).where(F.col("left") > SHORT)
        again = rest.join(nexts.select("hub", F.col("x.id").alias("next")), "hub").where("next <> id").select(F.col("next").alias("a"), F.col("id").alias("b"))
        got = stored(_similarity(again.distinct(), own, similar).select("a", "b"), "hubs")
        if got.isEmpty():
            break
        links.append(got)
        joined = got.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("new"))
        ends = got.groupBy(F.col("a").alias("id")).agg(F.min("a").alias("new"))
        joined = joined.unionByName(ends).groupBy("id").agg(F.min("new").alias("new"))
        state = stored(state.join(joined, "id", "left").select(*kept, F.coalesce("part", "new").alias("part")), "state")

    # What no hub has joined: pairs of different parts that can still be similar, found by size within a hub's members.
    held = _shared_shingles(members.select("id").distinct(), own)
    sizes = reps.select("id", "n").join(held, "id").where(F.col("held") >= t * F.col("n"))
    share, wide, base = t / (1 + t), math.ceil(-math.log(t) / math.log(1.02)) + 1, math.log(1.02)
    rows = state.join(sizes, "id").withColumn("step", F.floor(F.log(F.col("n").cast("double")) / base).cast("int"))
    rows = rows.withColumn("apart", F.col("lost") + F.col("n") - F.col("shared")).withColumn("may", F.col("lost") + F.col("held") - F.col("shared"))
    rows = stored(rows.select("hub", "id", "n", "held", "far", "apart", "may", "part", "step"), "rest")
    most = F.least(F.col("n") / t, F.col("held") / share - F.col("n"))
    steps = F.sequence(F.col("step") - wide, F.greatest(F.col("step") - wide, F.floor(F.log(F.greatest(most, F.lit(1.0))) / base).cast("int")))

    def side(x: str) -> list:
        return ["hub", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "held", "far", "apart", "may", "part")]]

    # One side in no hub's part of the component, or in another hub's than the first.
    one = rows.where("part is null or part <> hub").select(*side("a"), F.explode(steps).alias("step"))
    other = rows.select(*side("b"), "step")
    both = F.col("a_n") + F.col("b_n")
    can = (
        (F.col("a_id") != F.col("b_id"))
        & (F.col("a_part").isNull() | F.col("b_part").isNull() | (F.col("a_part") != F.col("b_part")))
        & (F.least("a_held", "b_held") >= share * both - 1e-6)
        & (F.col("a_n") >= t * F.col("b_n") - 1e-6) & (F.col("b_n") >= t * F.col("a_n") - 1e-6)
        & (F.abs(F.col("a_far") - F.col("b_far")) <= 1 - t + 1e-6)
        & (2 * F.least("a_may", "b_may") >= F.col("a_apart") + F.col("b_apart") - (1 - t) / (1 + t) * both - 1e-6)
    )
    tested = one.join(other, ["hub", "step"]).where(can).select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")).distinct()
    links.append(_similarity(_estimated(tested, reps, K, t), own, similar).select("a", "b"))
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    start = mark()
    found, path = stored_at(sketches(docs, id_col, text_col, k), "sketches", compression="zstd")
    filled = found.where("n > 0 and doc_id is not null")
    classes = stored(
        filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    links = _links(classes, texts, k, similar)
    # An id with several texts stands in several classes: they are one document.
    copied = classes.where("rows > 1").select("h1", "h2", "id", "rows")
    same = join_hot(filled.select("doc_id", "h1", "h2"), copied, ["h1", "h2"], "rows", filled.count()).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    comp, last = stored_at(components(links.unionByName(same)), "components")
    discard(docs.sparkSession, start, [path, last])
    return found.join(comp, found.doc_id == comp.id, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
