"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns a clause's words into symbols: insult, threat verb, person, negation, reporting verb, comma,
anything else. A comma or a line's end ends what a negation or a threat verb governs; a clause of one word, an
exclamation, belongs to the clause before it. Five
weighted transducers are composed, each reading what the one before writes. NEGATION reads an insult or threat after a
negation as denied, or, at a price that falls with the distance, as not governed by it. REPORT does so after a reporting
verb. TARGET reads an insult after a person as aimed at them, at a gain. THREAT joins a threat verb with the person after
it, at a gain. CLAUSE drops what is not worth its price and accepts only readings in which a pattern has company: a word
that stands alone scores nothing. Symbols may have several arcs, so a clause has many readings; the best is that
of greatest weight, found by dynamic programming over composed states, and its weight, with the insults' own, is what the
clause scores. A document's clause scores, not its words, enter a logistic score, fitted on labelled rows.

The insult lexicon is a seed list plus what labelled rows teach: words and word beginnings (stems) that are far more
frequent in toxic rows, each weighted by its log odds. Everything is learnt from at most ``SAMPLE`` labelled rows, those
of least id checksum, and never from a row whose id falls into the held-out fold. What the driver holds is bounded by
that sample: entries that at least ``LEAST_ROWS`` of its toxic rows have.

Defined results: a null or empty text has no clauses and gets the score of no match; a very long text is read whole,
clause by clause; readings of equal weight give the same score, and of equally good entries the shorter, then the later
in order, is taken; without labelled rows of both kinds the seed lexicon and prior weights score; rows that repeat an id
are scored one by one (the sample takes one of them); columns beside id and text are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import crc32_mod, labelled_sample, map_rows, table

#: Most labelled rows that lexicon and weights are learnt from.
SAMPLE = 16000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
LEAST_ROWS = 5
LEAST_SHARE = 0.5
#: Standard deviations that an entry's toxic rows must lie above chance, and the part of a stem's rows that one longer
#: entry may have before the stem, which then says nothing more, goes.
LEAST_DEVIATIONS = 6.5
MOST_OF_STEM = 0.7
STEM = (3, 9)

SEED_INSULTS = "idiot moron imbecile stupid dumb worthless pathetic disgusting trash scum loser clown fool vermin filth garbage bastard bitch asshole cretin parasite subhuman degenerate".split()
THREATS = "kill hurt destroy murder shoot stab beat punch attack burn strangle".split()
TARGETS = "you your yourself u he him she her they them people everyone tu toi vous ihr dich dir euch usted ustedes".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't without hardly pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says wrote writes quoted called claimed reported allegedly according dit écrit sagte schrieb dijo escribió".split()

INSULT, THREAT, PERSON, NOT, SAID, OTHER, COMMA = "ITPNRo,"
_CLAUSE = re.compile(r"[.;:!?|()]+")
_COMMA = re.compile(r"[,\n]")
_EDGE = "'\"“”‘’«»-–—*_#$%&<>[]{}/\\~`^+=@"
PATTERNS = ("plain", "denied", "reported", "aimed", "threat")
#: What the transducers write for an insult read as plain, denied, reported or aimed, for a threat, and for what is dropped.
PLAIN, DENIED, QUOTED, AIMED, MENACE, DROPPED = "IDQAHx"
_PATTERN_OF = dict(zip((PLAIN, DENIED, QUOTED, AIMED, MENACE), PATTERNS, strict=True))
#: Fixed weights of arcs: what a denied and a reported insult lose, what reading past a negation costs at each distance
#: and past a reporting verb, what a target adds, and what a threat is worth.
DENIAL, REPORT = -12.0, -6.0
PAST_NEGATION = (-9.0, -6.0, -3.0)
PAST_REPORT = -7.0
AT_TARGET, AS_THREAT = 1.0, 6.0

Arc = tuple[int, str, float]


class Transducer:
    """A weighted transducer: arcs (state, symbol) -> [(state, output, weight)]; a symbol without arcs passes through, to
    the state in ``passing``. States in ``refused`` end no reading."""

    def __init__(self, arcs: dict[tuple[int, str], list[Arc]], passing: dict[int, int], refused: frozenset[int] = frozenset()):
        self.arcs, self.passing, self.refused = arcs, passing, refused

    def step(self, state: int, symbol: str) -> list[Arc]:
        return self.arcs.get((state, symbol)) or [(self.passing.get(state, state), symbol, 0.0)]


class Composed:
    """Composition of transducers; states and arcs are made as they are met."""

    def __init__(self, *parts: Transducer):
        self.parts, self.cache = parts, {}
        self.start = (0,) * len(parts)

    def step(self, state: tuple[int, ...], symbol: str) -> list[tuple[tuple[int, ...], str, float]]:
        key = (state, symbol)
        if key not in self.cache:
            ways = [((), symbol, 0.0)]
            for part, s in zip(self.parts, state, strict=True):
                ways = [((*to, t), y, w + v) for to, x, w in ways for t, y, v in part.step(s, x)]
            best: dict[tuple, float] = {}
            for to, y, w in ways:
                best[to, y] = max(w, best.get((to, y), -math.inf))
            self.cache[key] = [(to, y, w) for (to, y), w in best.items()]
        return self.cache[key]

    def best(self, symbols: list[tuple[str, float]]) -> tuple[float, str]:
        """Weight and outputs of the best reading of (symbol, own weight) pairs; an own weight counts if it isn't dropped."""
        live: dict[tuple, tuple[float, str]] = {self.start: (0.0, "")}
        for symbol, own in symbols:
            new: dict[tuple, tuple[float, str]] = {}
            for state, (weight, said) in live.items():
                for to, y, w in self.step(state, symbol):
                    total = weight + w + (own if y in _PATTERN_OF and y != MENACE else 0.0)
                    if to not in new or (total, said + y) > new[to]:
                        new[to] = total, said + y
            live = new
        ends = [x for s, x in live.items() if not any(t in p.refused for p, t in zip(self.parts, s, strict=True))]
        return max(ends)


def _negation() -> Transducer:
    """After a negation, insults and threats within its reach are denied, or read past it at a price."""
    reach = len(PAST_NEGATION)
    arcs: dict[tuple[int, str], list[Arc]] = {(0, NOT): [(1, OTHER, 0.0)]}
    for s in range(1, reach + 1):
        after = s + 1 if s < reach else 0
        arcs[s, COMMA] = [(0, COMMA, 0.0)]
        arcs[s, NOT] = [(1, OTHER, 0.0)]
        arcs[s, INSULT] = [(after, DENIED, DENIAL), (after, INSULT, PAST_NEGATION[s - 1])]
        arcs[s, THREAT] = [(after, OTHER, 0.0), (after, THREAT, PAST_NEGATION[s - 1])]
    return Transducer(arcs, {s: (s + 1 if s < reach else 0) for s in range(1, reach + 1)})


def _report() -> Transducer:
    """After a reporting verb, insults and threats of the clause are reported, or the speaker's own at a price."""
    return Transducer({(0, SAID): [(1, OTHER, 0.0)], (1, INSULT): [(1, QUOTED, REPORT), (1, INSULT, PAST_REPORT)], (1, THREAT): [(1, OTHER, 0.0), (1, THREAT, PAST_REPORT)]}, {1: 1})


def _target(reach: int = 4) -> Transducer:
    """Insults within ``reach`` words after a person are aimed."""
    arcs: dict[tuple[int, str], list[Arc]] = {(0, PERSON): [(1, PERSON, 0.0)]}
    for s in range(1, reach + 1):
        after = s + 1 if s < reach else 0
        arcs[s, PERSON] = [(1, PERSON, 0.0)]
        arcs[s, INSULT] = [(after, AIMED, AT_TARGET), (after, PLAIN, 0.0)]
    return Transducer(arcs, {s: (s + 1 if s < reach else 0) for s in range(1, reach + 1)})


def _threat(reach: int = 3) -> Transducer:
    """A person within ``reach`` words after a threat verb makes a threat."""
    arcs: dict[tuple[int, str], list[Arc]] = {(0, THREAT): [(1, OTHER, 0.0)]}
    for s in range(1, reach + 1):
        arcs[s, COMMA] = [(0, COMMA, 0.0)]
        arcs[s, PERSON] = [(0, MENACE, AS_THREAT)]
        arcs[s, THREAT] = [(1, OTHER, 0.0)]
    return Transducer(arcs, {s: (s + 1 if s < reach else 0) for s in range(1, reach + 1)})


def _clause() -> Transducer:
    """Patterns may be dropped; one that is kept needs another word, be it a pattern too. 0: nothing yet, 1: one pattern
    only, 2: company."""
    arcs: dict[tuple[int, str], list[Arc]] = {}
    for y in (PLAIN, DENIED, QUOTED, AIMED):
        for s in (0, 1, 2):
            arcs[s, y] = [(2 if s else 1, y, 0.0), (s, DROPPED, 0.0)]
    # A threat is verb and person at least.
    for s in (0, 1, 2):
        arcs[s, MENACE] = [(2, MENACE, 0.0)]
        for x in (PERSON, NOT, SAID, THREAT, OTHER):
            arcs[s, x] = [(2, x, 0.0)]
    return Transducer(arcs, {}, frozenset((1,)))


def grammar() -> Composed:
    return Composed(_negation(), _report(), _target(), _threat(), _clause())


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.roles = {COMMA: COMMA} | {w: r for r, ws in ((THREAT, THREATS), (PERSON, TARGETS), (NOT, NEGATIONS), (SAID, REPORTS)) for w in ws}
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's symbol and, of insults, its weight."""
        got = self.known.get(word)
        if got is None:
            weight = self.words.get(word, 0.0)
            if weight <= 0:
                weight = max((self.stems.get(word[:n], 0.0) for n in range(STEM[0], min(STEM[1], len(word)) + 1)), default=0.0)
            got = (INSULT, weight) if weight > 0 else (self.roles.get(word, OTHER), 0.0)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = got
        return got


def clauses(text: str | None) -> list[list[str]]:
    """Words and commas of each clause. A clause of one word, an exclamation, belongs to the clause before it."""
    out: list[list[str]] = []
    for clause in _CLAUSE.split((text or "").lower()):
        words = [w for w in (x.strip(_EDGE) for x in _COMMA.sub(" , ", clause).split()) if w]
        if len(words) == 1 and out:
            out[-1] += [COMMA, words[0]]
        elif words:
            out.append(words)
    return out


def match(text: str | None, lexicon: Lexicon, composed: Composed) -> tuple[list[float], list[int]]:
    """The document's clause scores of matched clauses, and how many patterns of each kind their best readings hold."""
    scores, counts = [], dict.fromkeys(_PATTERN_OF, 0)
    for words in clauses(text):
        got = [lexicon.symbol(w) for w in words]
        if any(s in (INSULT, THREAT) for s, _ in got):
            weight, said = composed.best(got)
            if weight > 0:
                scores.append(weight)
                for y in said:
                    if y in counts:
                        counts[y] += 1
    return scores, list(counts.values())


def features(matched: list[list[float]]) -> np.ndarray:
    """Of documents' clause scores: 1, the logarithm of their sum, the greatest, and whether there are any."""
    total = np.array([math.fsum(x) for x in matched])
    most = np.array([max(x, default=0.0) for x in matched])
    return np.column_stack([np.ones(len(matched)), np.log1p(total), most / 8, (total > 0).astype(float)])


def _entries(text: str | None) -> set[str]:
    words = {w for c in clauses(text) for w in c if w != COMMA}
    out = {"=" + w for w in words if len(w) > 1}
    for w in words:
        out.update("^" + w[:n] for n in range(STEM[0], min(STEM[1], len(w)) + 1))
    return out


def _count(rows: DataFrame, label: int, among: frozenset | None) -> DataFrame:
    def per_batch(batch):
        c: Counter = Counter()
        for t, y in zip(batch["_text"].to_pylist(), batch["_label"].to_pylist(), strict=True):
            if y == label:
                found = _entries(t)
                c.update(found if among is None else found & among)
        return {"entry": list(c), "n": list(c.values())} if c else None

    return map_rows(rows.select("_text", "_label"), per_batch, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _covering(rows: DataFrame, weight: dict[str, float], least_gain: int = 3) -> list[str]:
    """Entries taken one by one while they reach toxic rows that those before don't, net of the clean rows they add.

    Words that are merely frequent in copies of a toxic text reach no row of their own and stay out.
    """
    among = frozenset(weight)

    def per_batch(batch):
        found = [sorted(_entries(t) & among) for t in batch["_text"].to_pylist()]
        return {"label": batch["_label"], "found": found}

    held: dict[str, list[set]] = {e: [set(), set()] for e in weight}
    got = map_rows(rows.select("_text", "_label"), per_batch, "label int, found array<string>").where(F.size("found") > 0).collect()
    for i, r in enumerate(sorted(got)):
        for e in r.found:
            held[e][r.label].add(i)
    chosen = []
    while held:
        best = max(held, key=lambda e: (len(held[e][1]) - len(held[e][0]), -len(e), e))
        clean, toxic = held.pop(best)
        if len(toxic) - len(clean) < least_gain:
            break
        chosen.append(best)
        for e in [e for e, (c, t) in held.items() if not t.isdisjoint(toxic) or not c.isdisjoint(clean)]:
            held[e][0] -= clean
            held[e][1] -= toxic
    return chosen


def _fit(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - decay * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights of ``features`` where no labelled rows teach any.
PRIOR = np.array([-2.5, 1.0, 1.0, 0.5])


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    rows = labelled_sample(docs.select("doc_id", F.col(text_col).alias("_text")), labels, "toxic", sample, crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    words, stems = dict.fromkeys(SEED_INSULTS, 2.0), {}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon(words, stems), PRIOR
    # Few entries are frequent in the toxic rows of a bounded sample, and few of those are rare in the others.
    often = {r.entry: r.n for r in _count(rows, 1, None).where(F.col("n") >= LEAST_ROWS).collect()}
    clean = {r.entry: r.n for r in _count(rows, 0, frozenset(often)).collect()}
    base, rate = math.log(n1 / n0), n1 / (n1 + n0)
    longer: dict[str, int] = {}
    for entry, a in often.items():
        stem = "^" + (entry[1:-1] if entry[0] == "^" else entry[1:])
        longer[stem] = max(longer.get(stem, 0), a)
    good = []
    for entry, a in often.items():
        b = clean.get(entry, 0)
        odds = math.log((a + 0.5) / (b + 0.5)) - base
        deviations = (a - (a + b) * rate) / math.sqrt((a + b) * rate * (1 - rate))
        if a >= LEAST_SHARE * (a + b) and deviations >= LEAST_DEVIATIONS and longer.get(entry, 0) < MOST_OF_STEM * a:
            good.append((entry, odds))
    weight = dict(good)
    for entry in _covering(rows, weight):
        (words if entry[0] == "=" else stems)[entry[1:]] = weight[entry]
    lexicon = Lexicon(words, stems)
    composed = grammar()

    def per_batch(batch):
        return {"doc_id": batch["doc_id"], "label": batch["_label"], "scores": [match(t, lexicon, composed)[0] for t in batch["_text"].to_pylist()]}

    got = sorted(map_rows(rows.select("doc_id", "_text", "_label"), per_batch, "doc_id long, label int, scores array<double>").collect())
    x = features([r.scores for r in got])
    return lexicon, _fit(x, np.array([r.label for r in got], float))


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, matched, and the number of patterns of each kind) of every row."""
    composed = grammar()

    def per_batch(batch):
        got = [match(t, lexicon, composed) for t in batch[text_col].to_pylist()]
        p = 1 / (1 + np.exp(-np.clip(features([x for x, _ in got]) @ weights, -30, 30)))
        counts = np.array([c for _, c in got], np.int64).reshape(-1, len(PATTERNS))
        matched = [math.fsum(x) for x, _ in got]
        return {"doc_id": batch[id_col], "score": p, "predicted": (p >= THRESHOLD).astype(np.int32), "matched": matched} | {n: counts[:, i] for i, n in enumerate(PATTERNS)}

    return map_rows(docs.select(id_col, text_col), per_batch, "doc_id long, score double, predicted int, matched double, " + ", ".join(f"{n} long" for n in PATTERNS))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, weights = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs, lexicon, weights)
    return out.withColumn("held_out", crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
