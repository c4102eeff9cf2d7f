"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end a text. A token has a class and a group in its class, functions of its letters
alone: the end, the most frequent tokens and the most frequent endings have classes of their own, the rest share some by
hash; the group is a hash. P(token | history) = P(class | history) * P(group | class, history) * P(token | group). The
first two factors are maximum-entropy models over hashed features of the words before. Of the
class: the last word (n-gram), the one before it and the fourth (skips), and the last two together (n-gram); of the
group: the class, and the class with the last word and with the one before it. A word is named by itself if it is among
the ``HEAD`` most frequent and by its ending if not, so rare words share what they teach. The third factor has bias
features only, whose weights are the smoothed counts: (c + 0.5) over the group's sum, half a count for an unseen token.

Training: ``ROUNDS`` gradient steps. Every round takes all training texts, adds up observed and
expected feature counts under the current weights, and moves the weights along observed less expected, scaled by the
expected (a diagonal preconditioner) over the number of features a token has, times ``STEP``. A token's residuals are rounded to
``UNIT``, so the sums are of integers: weights and scores are the same under any partitioning, batching and order of
rows, and a task that runs again adds the same. Tasks send only rows of features they met; sums run in Spark before the
driver sees one table of fixed size.

The number of rounds stops the fit early: more rounds fit the training texts further and others less.

Texts are cut into tokens once for all rounds and the scores: what features need of a token, six bytes, is stored.
Scoring is forward only, in numpy batches: each token gathers the few weight rows of its features.

Counts are exact and cover all training texts. A text's sum over head tokens (a bounded table sent to all tasks) is taken
where the text is read; only its rarer tokens are joined with the counts, by the token itself. Where more tokens tie for
the head than it holds, a hash chooses among them.

Defined results: a null or empty text has the end alone; very long texts are scored whole, in batches; rows that repeat
are scored one by one; a null id counts as the empty id for folds; tied counts are ordered by token; without training
texts all counts are 0 and the model is uniform; columns beside id and text are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import _arrow_schema, crc32_mod, map_rows, slices, stored, table

FOLDS, HELD_OUT = 5, 1
#: Classes, and groups of a class.
CLASSES, GROUPS = 32, 16
FREQUENT, ENDINGS = 7, 20
#: Most frequent tokens that every task holds.
HEAD = 100_000
ROUNDS = 3
#: Steps are longer than the safe one, in which features that a token has together move it together.
STEP = 2.5
#: Rows a feature counts as having expected beforehand, and the furthest a weight goes in a round.
CALM = 20.0
FURTHEST = 2.0
#: Residuals of a token are rounded to one part in this; a batch's sums of them fit 32 bits.
UNIT = 1 << 16
BATCH = 1 << 14
#: Tokens of a batch that are worked on at once, in the processor's cache.
NEAR = 1 << 11
END = b"\n"
#: Tokens a worker remembers, from task to task of one model.
REMEMBERED = 500_000
_PUNCTUATION = b".,;:!?\"'()[]|*#$%&"

#: Rows of the feature regions of each factor's weights: of the class, then of the group.
SIZES = ((1, 4096, 2048, 2048, 4096), (CLASSES, 4096, 2048))
OUTCOMES = (CLASSES, GROUPS)
FIRST = tuple(tuple(sum(sizes[:i]) for i in range(len(sizes) + 1)) for sizes in SIZES)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> bytes:
    return word.strip(_PUNCTUATION)[-3:]


class Classes(dict):
    """The class of an ending and a name of it as a hash, filled as endings come; and the classes that are one token."""

    def __init__(self, frequent: list[bytes], endings: list[bytes]):
        super().__init__()
        self.fixed = {END: 0} | {w: i + 1 for i, w in enumerate(frequent)}
        self.endings = {e: 1 + FREQUENT + i for i, e in enumerate(endings)}

    def __reduce__(self):
        return (Classes, ([w for w in self.fixed if w != END], list(self.endings)))

    def __missing__(self, tail: bytes) -> tuple[int, int]:
        first, hashed = 1 + FREQUENT + ENDINGS, zlib.crc32(tail)
        got = self.endings.get(tail, first + hashed % (CLASSES - first)), hashed
        if len(self) > REMEMBERED:
            self.clear()
        self[tail] = got
        return got

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, group, hash of the token and hash of its ending."""
        n, fixed = len(tokens), self.fixed
        tails = np.array([self[w.strip(_PUNCTUATION)[-3:]] for w in tokens], np.uint32).reshape(-1, 2)
        own = np.fromiter((fixed.get(w, -1) for w in tokens), np.int64, n)
        hashed = np.fromiter(map(zlib.crc32, tokens), np.uint32, n)
        return np.where(own < 0, tails[:, 0], own), (hashed * np.uint32(0x9E3779B1)) >> np.uint32(33 - GROUPS.bit_length()), hashed, ~tails[:, 1]


class Vocabulary(dict):
    """Token -> number; by number: class, group, name hash and log10 of the head's smoothed count, or NaN.

    Tokens get numbers as they come and the rest in ``fill``.
    """

    def __init__(self, classes: Classes, head: dict[bytes, int]):
        super().__init__()
        self.classes, self.head = classes, head
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.tokens: list[bytes] = []
        self.klass, self.group = np.empty(0, np.uint8), np.empty(0, np.uint8)
        self.name, self.log = np.empty(0, np.uint32), np.empty(0)
        self[END]

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.tokens.append(word)
        return i

    def fill(self) -> None:
        new = self.tokens[len(self.klass) :]
        klass, group, word, tail = self.classes.of(new)
        counts = np.fromiter((self.head.get(w, 0) for w in new), np.int64, len(new))
        log = np.where(counts > 0, np.log10(counts + 0.5), np.nan)
        for a, more in (("klass", klass), ("group", group), ("name", np.where(counts > 0, word, tail)), ("log", log)):
            old = getattr(self, a)
            setattr(self, a, np.concatenate([old, more.astype(old.dtype)]))

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self._empty()


_last: list[tuple[str, Vocabulary]] = []


def vocabulary_of(key: str, classes: Classes, head: dict[bytes, int]) -> Vocabulary:
    """The vocabulary that an earlier task of the same model left in this worker, or a new one."""
    if not _last or _last[0][0] != key:
        _last[:] = [(key, Vocabulary(classes, head))]
    return _last[0][1]


def numbered(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers with four ends before every text, the places of the tokens in them, and where each text ends."""
    get, flat, ends = vocabulary.__getitem__, [], []
    for t in texts:
        flat += (0, 0, 0, 0)
        before = len(flat)
        flat += map(get, words(t))
        flat.append(0)
        ends.append(len(flat) - before)
    vocabulary.fill()
    stops = np.cumsum(ends)
    at = np.arange(stops[-1] if len(stops) else 0) + 4 * np.repeat(np.arange(1, len(ends) + 1), ends)
    return np.array(flat, np.int64), at, stops


def _fold(x: np.ndarray, odd: int, size: int) -> np.ndarray:
    """A hash of 32 bits to ``size`` (a power of two) values."""
    return ((x * np.uint32(odd)) >> np.uint32(33 - size.bit_length())).astype(np.int64)


def feature_rows(names: np.ndarray, classes: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray | None], list[np.ndarray]]:
    """Rows in each region of both factors for the tokens at ``at``; None for the class's bias, which all have."""
    one, two, four = names[at - 1], names[at - 2], names[at - 4]
    mixed = classes[at].astype(np.uint32) * np.uint32(0x9E3779B1)
    (_, n1, n2, n4, n12), (_, c1, c2) = SIZES
    of_class = [None, _fold(one, 0x85EBCA6B, n1), _fold(two, 0xC2B2AE35, n2), _fold(four, 0x27D4EB2F, n4), _fold(one ^ (two * np.uint32(0x165667B1)), 0x9E3779B1, n12)]
    return of_class, [classes[at].astype(np.int64), _fold(one ^ mixed, 0x85EBCA6B, c1), _fold(two ^ mixed, 0xC2B2AE35, c2)]


def probabilities(w: np.ndarray, rows: list[np.ndarray | None], first: tuple[int, ...], n: int) -> np.ndarray:
    """(n, outcomes): the softmax of the sums of the rows that each token's features name."""
    out = powers(w, rows, first, n)
    out /= out.sum(1, keepdims=True)
    return out


def powers(w: np.ndarray, rows: list[np.ndarray | None], first: tuple[int, ...], n: int) -> np.ndarray:
    """Probabilities before they are divided by their sum."""
    out = np.empty((n, w.shape[1]), np.float32)
    regions = [(w[first[i] : first[i + 1]], r) for i, r in enumerate(rows) if r is not None]
    always = w[0] if len(regions) < len(rows) else np.zeros(w.shape[1], np.float32)
    for i in range(0, n, NEAR):
        s = out[i : i + NEAR]
        s[:] = always
        for part, r in regions:
            s += part.take(r[i : i + NEAR], axis=0)
        np.exp(s, out=s)
    return out


def both(weights: list[np.ndarray], rows: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """P(class | history) and P(group | class, history) of n tokens."""
    return probabilities(weights[0], rows[0], FIRST[0], n), probabilities(weights[1], rows[1], FIRST[1], n)


class Sums:
    """Of one factor: observed counts and, in units, expected ones, by outcome and row: whole numbers."""

    def __init__(self, factor: int):
        self.first, self.outcomes = FIRST[factor], OUTCOMES[factor]
        self.seen, self.expected = np.zeros((self.outcomes, self.first[-1])), np.zeros((self.outcomes, self.first[-1]))
        self.units = np.empty((self.outcomes, BATCH))

    @property
    def gap(self) -> np.ndarray:
        """Observed less expected, in units."""
        return UNIT * self.seen - self.expected

    def observe(self, rows: list[np.ndarray | None], target: np.ndarray) -> None:
        _tally(self.seen, self.first, rows, target)

    def add(self, p: np.ndarray, rows: list[np.ndarray | None], target: np.ndarray | None) -> None:
        """Takes tokens' probabilities, or numbers in proportion to them, rows and outcomes (None: observed before) of one ``BATCH`` at most."""
        n = len(p)
        units = self.units[:, :n]
        for i in range(0, n, NEAR // 4):
            units[:, i : i + NEAR // 4] = _units(p[i : i + NEAR // 4])
        for i, r in enumerate(rows):
            here, size = slice(self.first[i], self.first[i + 1]), self.first[i + 1] - self.first[i]
            if r is None:
                self.expected[:, here] += units.sum(1, keepdims=True)
            else:
                for o in range(self.outcomes):
                    self.expected[o, here] += np.bincount(r, units[o], size)
        if target is not None:
            self.observe(rows, target)


def _units(p: np.ndarray) -> np.ndarray:
    """(outcomes, n): probabilities in units, from (n, outcomes) numbers in proportion to them."""
    p = np.ascontiguousarray(p.T)
    p *= np.float32(UNIT) / p.sum(0)
    return np.rint(p, out=p)


def _tally(counts: np.ndarray, first: tuple[int, ...], rows: list[np.ndarray | None], which: np.ndarray) -> None:
    for i, r in enumerate(rows):
        np.add.at(counts.reshape(-1), which * first[-1] + first[i] + (0 if r is None else r), 1.0)


class Beginning:
    """Sums of both factors under ``start_weights``: those know no history, so numbers of tokens by class and row give the expected counts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights, self.sums, self.tokens = weights, (Sums(0), Sums(1)), np.zeros((CLASSES, FIRST[1][-1]))

    def add(self, rows: tuple, kinds: np.ndarray, groups: np.ndarray) -> None:
        for x, r, target in zip(self.sums, rows, (kinds, groups), strict=True):
            x.observe(r, target)
        _tally(self.tokens, FIRST[1], rows[1], kinds)

    def end(self) -> tuple[Sums, Sums]:
        of_class, of_group = self.sums
        of_class.expected = _units(np.exp(self.weights[0][:1])).astype(float) * of_class.seen.sum(0)
        of_group.expected = _units(np.exp(self.weights[1][:CLASSES])).astype(float) @ self.tokens
        return self.sums


def count_tokens(train: DataFrame, text_col: str) -> DataFrame:
    """(token, n) over all training texts."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
        held: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for t in batch[0].to_pylist():
                    held.update(words(t))
                    held[END] += 1
                if len(held) > 700_000:
                    yield pa.RecordBatch.from_pydict({"token": list(held), "n": list(held.values())}, schema=schema)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"token": list(held), "n": list(held.values())}, schema=schema)

    return train.select(text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _masses(counts: DataFrame, classes: Classes) -> np.ndarray:
    """Smoothed counts by class and group."""

    def per_batch(batch):
        klass, group, _, _ = classes.of(batch["token"].to_pylist())
        at = klass.astype(np.int64) * GROUPS + group
        tokens, n = np.bincount(at, minlength=CLASSES * GROUPS), np.zeros(CLASSES * GROUPS, np.int64)
        np.add.at(n, at, batch["n"].to_numpy())
        return {"k": np.arange(len(n)), "tokens": tokens, "n": n}

    out = np.full(CLASSES * GROUPS, 0.5)
    for r in map_rows(counts, per_batch, "k int, tokens long, n long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect():
        out[r.k] += r.n + 0.5 * r.tokens
    return out.reshape(CLASSES, GROUPS)


def head_of(counts: DataFrame, most: int) -> dict[bytes, int]:
    """About the ``most`` most frequent tokens and their counts, found by histograms: no task sorts or sends its own best.

    Of the bin that the bound cuts, tokens of least hash are taken: so many that more than ``most`` in all come with a
    chance of 1e-9, and the bound holds where any number of tokens tie.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 16.0)
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()
    taken, lowest, share = 0, None, 0.0
    for r in sorted(bins, key=lambda r: -r.level):
        lowest, room = r.level, most - taken
        share = 1.0 if r.tokens <= room else max(0.0, room - 6 * math.sqrt(room)) / r.tokens
        taken += r.tokens
        if share < 1.0:
            break
    if lowest is None:
        return {}
    lucky = F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = counts.where((level > lowest) | ((level == lowest) & lucky)).collect()
    return dict(sorted(((bytes(r.token), r.n) for r in rows), key=lambda x: (-x[1], x[0])))


def packed(values: np.ndarray, stops: np.ndarray):
    """An Arrow array of binary values: each text's part of an array, given where they end."""
    import pyarrow as pa

    places = np.r_[0, stops * values.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(places), pa.py_buffer(values)])


def unpacked(column, kind: type) -> np.ndarray:
    """The array that ``packed`` cut."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    _, places, values = column.buffers()
    places = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values, kind, (places[-1] - places[0]) // np.dtype(kind).itemsize, places[0])


def read_numbers(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, classes and groups with four ends before every text, the places of the tokens, and where each text ends."""
    lengths = batch["n_tokens"].to_numpy()
    stops = np.cumsum(lengths)
    at = np.arange(stops[-1]) + 4 * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    kinds = np.zeros(len(at) + 4 * len(lengths), np.uint16)
    names = np.empty(len(kinds), np.uint32)
    some_names, some_kinds = unpacked(batch["names"], np.uint32), unpacked(batch["kinds"], np.uint16)
    # Every text's last token is its end.
    names[:], kinds[:] = some_names[-1], some_kinds[-1]
    names[at], kinds[at] = some_names, some_kinds
    return names, kinds // GROUPS, kinds % GROUPS, at, stops


def train_round(texts: DataFrame, weights: list[np.ndarray], seen: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The weights after a gradient step over all ``texts``, and the observed counts: None for the first step, from ``start_weights``;
    later ones get them."""
    shipped, first = texts.sparkSession.sparkContext.broadcast(weights), seen is None
    columns = ("expected", "seen")[: 1 + first]
    schema = "factor int, row int, " + ", ".join(f"{c} array<long>" for c in columns)
    arrow = _arrow_schema(texts.sparkSession, schema)

    def run(batches):
        import pyarrow as pa

        now = shipped.value
        sums, beginning = (Sums(0), Sums(1)), Beginning(now) if first else None
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                names, kinds, groups, at, _ = read_numbers(batch)
                for i in range(0, len(at), BATCH):
                    here = at[i : i + BATCH]
                    rows = feature_rows(names, kinds, here)
                    if beginning:
                        beginning.add(rows, kinds[here].astype(np.int64), groups[here].astype(np.int64))
                        continue
                    for total, w, r in zip(sums, now, rows, strict=True):
                        total.add(powers(w, r, total.first, len(here)), r, None)
        if beginning:
            sums = beginning.end()
        for factor, x in enumerate(sums):
            met = np.flatnonzero(x.seen.any(0) | x.expected.any(0))
            if len(met):
                places = pa.array(np.arange(len(met) + 1, dtype=np.int32) * x.outcomes)
                lists = [pa.ListArray.from_arrays(places, pa.array(getattr(x, c)[:, met].T.astype(np.int64).ravel())).cast(arrow.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), factor, np.int32)), pa.array(met.astype(np.int32)), *lists], schema=arrow)

    names = [(c, i) for c in columns for i in range(CLASSES)]
    # The group's lists are shorter: their other sums are null.
    sums = texts.mapInArrow(run, schema).groupBy("factor", "row").agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, i in names])
    total = [np.zeros((len(columns), FIRST[f][-1], CLASSES)) for f in (0, 1)]
    for r in sums.collect():
        total[r[0]][:, r[1]] = np.array([x or 0 for x in r[2:]], float).reshape(len(columns), CLASSES)
    shipped.destroy()
    out, seen = [], [x[1] for x in total] if first else seen
    for w, (expected, *_), here, sizes in zip(weights, total, seen, SIZES, strict=True):
        expected, here = expected[:, : w.shape[1]] / UNIT, here[:, : w.shape[1]]
        step = STEP * (here - expected) / (expected + CALM) / len(sizes)
        out.append(np.clip(w + np.clip(step, -FURTHEST, FURTHEST), -12, 12).astype(np.float32))
    return out, seen


def start_weights(masses: np.ndarray) -> list[np.ndarray]:
    """Biases from the counts: the model is then that of the counts alone."""
    out = [np.zeros((first[-1], n), np.float32) for first, n in zip(FIRST, OUTCOMES, strict=True)]
    out[0][0] = np.clip(np.log(masses.sum(1) / masses.sum()), -12, 0)
    out[1][:CLASSES] = np.clip(np.log(masses / masses.sum(1, keepdims=True)), -12, 0)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    fold = crc32_mod(F.col(id_col), folds)
    train = docs.where(fold != held_out)
    counts = stored(count_tokens(train, text_col), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = math.log10(total + 0.5 * (distinct + 1))
    top = head_of(counts, HEAD)
    head = spark.sparkContext.broadcast(top)
    frequent = [w for w in top if w != END][:FREQUENT]
    tails: Counter = Counter()
    for w, n in top.items():
        tails[ending(w)] += n
    classes = Classes(frequent, [e for e, _ in sorted(tails.items(), key=lambda x: (-x[1], x[0]))[:ENDINGS]])
    masses = _masses(counts, classes)
    key = uuid.uuid4().hex
    share = np.log10(masses) - norm

    schema = "doc_id long, held_out boolean, n_tokens long, known long, sum double, rare array<struct<token:binary,n:int>>, names binary, kinds binary"
    arrow = _arrow_schema(spark, schema)

    def number(batches):
        import pyarrow as pa

        vocabulary = vocabulary_of(key, classes, head.value)
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                flat, at, stops = numbered(vocabulary, batch[1].to_pylist())
                starts = np.r_[0, stops[:-1]].astype(np.int64)
                ids = flat[at]
                log = vocabulary.log[ids]
                rare = np.isnan(log)
                log[rare] = 0.0
                sums, n_rare = (np.add.reduceat(x, starts) if len(starts) else x for x in (log, rare.astype(np.int64)))
                n = np.diff(np.r_[0, stops])
                # Rare tokens of each text with their numbers of times.
                row = np.repeat(np.arange(len(n)), n)[rare]
                pairs, times = np.unique(row * len(vocabulary) + ids[rare], return_counts=True)
                at_rare = np.searchsorted(pairs // max(len(vocabulary), 1), np.arange(len(n) + 1))
                tokens = [vocabulary.tokens[i] for i in (pairs % max(len(vocabulary), 1)).tolist()]
                lists = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int32())], ["token", "n"])
                lists = pa.ListArray.from_arrays(pa.array(at_rare, pa.int32()), lists)
                kinds = vocabulary.klass[ids].astype(np.uint16) * GROUPS + vocabulary.group[ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch[0].cast(pa.int64()), batch[2], pa.array(n, pa.int64()), pa.array(n - n_rare, pa.int64()), pa.array(sums),
                        lists.cast(arrow.field("rare").type), packed(vocabulary.name[ids], stops), packed(kinds, stops),
                    ], schema=arrow
                )
                vocabulary.trim()

    read = stored(
        docs.select(id_col, text_col, (fold == held_out).alias("_held")).mapInArrow(number, schema).withColumn("row", F.monotonically_increasing_id()), "numbers", compression="zstd"
    )
    weights, seen = start_weights(masses), None
    for _ in range(ROUNDS):
        weights, seen = train_round(read.where(~F.col("held_out")).select("n_tokens", "names", "kinds"), weights, seen)
    model = spark.sparkContext.broadcast(weights)
    columns = "row long, doc_id long, held_out boolean, n_tokens long, known long, sum double, gain double"
    scored = _arrow_schema(spark, columns)

    def score(batches):
        import pyarrow as pa

        w = model.value
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                names, kinds, groups, at, stops = read_numbers(batch)
                gain = np.empty(len(at))
                for i in range(0, len(at), BATCH):
                    here = at[i : i + BATCH]
                    k, g = kinds[here].astype(np.int64), groups[here].astype(np.int64)
                    p, q = (powers(*x, len(here)) for x in zip(w, feature_rows(names, kinds, here), FIRST, strict=True))
                    every = np.arange(len(here))
                    gain[i : i + BATCH] = np.log10((p[every, k] / p.sum(1)).astype(float)) + np.log10((q[every, g] / q.sum(1)).astype(float)) - share[k, g]
                gains = np.add.reduceat(gain, np.r_[0, stops[:-1]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(gains)], schema=scored)

    results = stored(read.select("row", "doc_id", "held_out", "n_tokens", "known", "sum", "names", "kinds").mapInArrow(score, columns), "scores")
    rare = read.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.n")
    joined = rare.join(counts.withColumnRenamed("n", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tails_ = joined.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    base = F.col("sum") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return results.join(tails_, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
