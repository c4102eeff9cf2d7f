"""Quality rules judged by an isolation forest.

Every text becomes a few rule statistics, in units of their spread among good rows. Trees of random splits over them, the
statistic drawn in proportion to its range and the cut within it, give short paths to documents that are easy to isolate; the anomaly score is 2 ** (-mean path / expected path). All labelled
rows are read. One half of them, by id checksum, grows the trees: the spread is that of all its good rows, and every tree
draws about ``SUBSAMPLE`` rows from the whole half, good ones and a few bad ones, as an isolation forest wants anomalies
few. The threshold is calibrated on all rows of the other half, which the trees haven't seen: by exact counts of their
scores, the one that separates best among those that keep at least ``KEEP_GOOD`` of its good rows. All documents are scored.

Defined results: a null or empty text has no words, so all counts are 0 and the base rule rejects it; a very long text is
counted whole; rows that repeat an id are judged one by one (fitting takes the one of least statistics); documents of equal statistics
get equal scores, and one at the threshold stays; without labelled rows of both kinds in each half only the base rule
rejects; columns of the names that are added are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import discard, map_rows, mark, stored, table

#: Scores are counted to one part in this for the threshold.
BINS = 1 << 16
TREES = 160
SUBSAMPLE = 512
KEEP_GOOD = 0.998
#: Rows labelled bad among those that trees are grown from, at most: more of them would hide each other.
BAD_SHARE = 0.01
#: Least spread of a statistic.
LEAST_SPREAD = 0.001
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _CAPITALS + _CAPITALS.lower()
_DIGITS = b"0123456789"
STATISTICS = ("symbols", "repeats", "repeated_lines", "capitals", "shouts", "echoes", "commonest", "word_chars", "digits", "variety")


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rule statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(STATISTICS)
    solid = raw.translate(None, _SPACE)
    chars = len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup_lines, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        windows = (codes[:-2] * len(index) + codes[1:-1]) * len(index) + codes[2:] if len(index) < 2_000_000 else _ranked(codes)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    counts = np.bincount(codes)
    return [n, chars, symbols, dup_lines, repeated], [
        min(symbols / n, 4.0),
        repeated / n,
        dup_lines / lines,
        capitals / max(letters, 1),
        min((raw.count(b"!") + raw.count(b"?")) / n, 4.0),
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0,
        float(counts.max()) / n if n >= 20 else 0.0,
        min(chars / n, 40.0),
        digits / max(len(solid), 1),
        math.log(len(index) + 1) / math.log(n + 1),
    ]


def _ranked(codes: np.ndarray) -> np.ndarray:
    pairs = np.unique(codes[:-1] * (int(codes.max()) + 1) + codes[1:], return_inverse=True)[1]
    return pairs[:-1] * (int(codes.max()) + 1) + codes[2:]


def _expected(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Arrays of all trees: node i of a tree splits on feature[i] at cut[i]; leaves point to themselves."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        bad = np.flatnonzero(~good)
        bad = rng.permutation(bad)[: max(1, int(BAD_SHARE * good.sum()))]
        rows, spread = rows[np.sort(np.concatenate([np.flatnonzero(good), bad]))], rows[good].std(0) + LEAST_SPREAD
        m = min(subsample, len(rows))
        self._plant(spread, [rows[rng.choice(len(rows), m, replace=False)] for _ in range(trees)], rng)

    @classmethod
    def of(cls, spread: np.ndarray, drawn: list[np.ndarray], seed: int = 7) -> Forest:
        """``drawn``: each tree's rows, in an order that doesn't depend on partitioning."""
        out = cls.__new__(cls)
        out._plant(spread, drawn, np.random.default_rng(seed))
        return out

    def _plant(self, spread: np.ndarray, drawn: list[np.ndarray], rng: np.random.Generator) -> None:
        self.spread = spread
        self.depth = max(1, math.ceil(math.log2(max(2, *map(len, drawn)))))
        self.norm = _expected(sum(map(len, drawn)) / len(drawn)) or 1.0
        self.trees = [self._grow(rows / spread, rng) for rows in drawn]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator):
        feature, cut, child, length = [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            i = len(feature)
            feature.append(0)
            cut.append(np.inf)
            child.append((i, i))
            length.append(depth + _expected(len(part)))
            if depth < self.depth and len(part) > 1:
                low, high = part.min(0), part.max(0)
                if (span := high - low).any():
                    f = int(rng.choice(len(span), p=span / span.sum()))
                    at = rng.uniform(low[f], high[f])
                    feature[i], cut[i] = f, at
                    left = part[:, f] <= at
                    child[i] = (node(part[left], depth + 1), node(part[~left], depth + 1))
            return i

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = rows / self.spread
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = child[at, (rows[every, feature[at]] > cut[at]).astype(np.int64)]
            total += length[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.norm)


def base_failed(base: list[int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]


def _measured(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, label, stats, grows) of all labelled ids that pass the base rule, stored. Texts aren't shuffled."""

    def measure(batch):
        got = [statistics(t) for t in batch["_text"].to_pylist()]
        keep = [i for i, (b, _) in enumerate(got) if not base_failed(b)]
        ids = batch["doc_id"].to_pylist()
        return {"doc_id": [ids[i] for i in keep], "stats": [got[i][1] for i in keep]}

    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = map_rows(docs.where("doc_id is not null").select("doc_id", F.col(text_col).alias("_text")), measure, "doc_id long, stats array<double>")
    rows = rows.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("stats").alias("stats"))
    half = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":half")).cast("binary")) % 2
    return stored(rows.withColumn("label", F.col("label") == 1).withColumn("grows", half == 0), "measured")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> tuple[Forest | None, float]:
    """Forest and threshold from all labelled rows that pass the base rule."""
    since = mark()
    rows = _measured(docs, labels, text_col)
    n = {(r.grows, r.label): r.n for r in rows.groupBy("grows", "label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 4:
        discard(docs.sparkSession, since)
        return None, math.inf
    of_good = rows.where("grows and label").agg(*[F.stddev_pop(F.col("stats")[i]) for i in range(len(STATISTICS))]).first()
    spread = np.array([float(f"{x:.9e}") for x in of_good]) + LEAST_SPREAD
    # Every growing row is drawn for each tree by itself, bad ones so rarely that they stay few.
    bad = min(1.0, max(1.0, BAD_SHARE * n[True, True]) / n[True, False])
    share = min(1.0, SUBSAMPLE / (n[True, True] + bad * n[True, False]))

    def draw(batch):
        ids, good, stats = (batch[c].to_pylist() for c in ("doc_id", "label", "stats"))
        out = {"tree": [], "doc_id": [], "stats": []}
        for i, g, x in zip(ids, good, stats, strict=True):
            for t in np.flatnonzero(np.random.default_rng(i % 2**64).random(TREES) < share * (1.0 if g else bad)).tolist():
                out["tree"].append(t)
                out["doc_id"].append(i)
                out["stats"].append(x)
        return out

    drawn: dict[int, list] = {}
    for r in map_rows(rows.where("grows").select("doc_id", "label", "stats"), draw, "tree int, doc_id long, stats array<double>").collect():
        drawn.setdefault(r.tree, []).append((r.doc_id, r.stats))
    forest = Forest.of(spread, [np.array([x for _, x in sorted(drawn[t])]) for t in sorted(drawn)])

    def rank(batch):
        scores = forest.score(np.array(batch["stats"].to_pylist()).reshape(-1, len(STATISTICS)))
        return {"bin": np.ceil(scores * BINS).astype(np.int64), "good": batch["label"]}

    # Exact counts of the other half by score, to one part in BINS.
    counted = map_rows(rows.where("not grows").select("label", "stats"), rank, "bin long, good boolean").groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("bin").collect()
    discard(docs.sparkSession, since)
    good, bad_ = (np.cumsum([r[c] for r in counted]) for c in ("good", "bad"))
    cuts = np.array([r.bin for r in counted]) / BINS
    cuts[:-1] = (cuts[:-1] + np.maximum(cuts[:-1], cuts[1:] - 1 / BINS)) / 2
    enough = np.flatnonzero(good >= KEEP_GOOD * good[-1])
    best = enough[np.argmax((good / good[-1] - bad_ / bad_[-1])[enough])]
    return forest, float(cuts[best])


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly and kept."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")
    docs = docs.drop(*added)
    forest, threshold = fit(docs, labels, text_col)
    names = docs.columns

    def score(batch):
        got = [statistics(t) for t in batch[text_col].to_pylist()]
        base = np.array([b for b, _ in got], np.int64).reshape(-1, 5)
        failed = [base_failed(b) for b, _ in got]
        anomaly = forest.score(np.array([s for _, s in got])) if forest and got else np.zeros(len(got))
        kept = [not f and bool(a <= threshold) for f, a in zip(failed, anomaly, strict=True)]
        return {c: batch[c] for c in names} | {a: base[:, i] for i, a in enumerate(added[:5])} | {"base_failed": failed, "anomaly": anomaly, "kept": kept}

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, score, own + ", " + ", ".join(f"{a} long" for a in added[:5]) + ", base_failed boolean, anomaly double, kept boolean")


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.drop("text")
