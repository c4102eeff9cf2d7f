"""SentencePiece encoding and decoding with a Viterbi pass that words share by their prefixes.

A text with one space put before it is cut into marked words (leading spaces and what follows them) and line ends; no
piece of the model but runs of spaces crosses such a cut, so the best segmentation of the text is that of its words.
Distinct words are sorted, which is the depth-first order of their trie: the forward scores of the prefix shared with the
word before are kept, and only positions beyond it are computed. Pieces that end at a position are found by walking a
trie of reversed pieces.

A forward score is the sum of the piece scores of the best segmentation of a prefix. In a model of the unigram kind every
piece may follow every other. In a model of the BPE kind a piece may follow another only if merging makes these two of
their joined text, a join that is looked up, or worked out and remembered; other joins score minus infinity. One
segmentation of a prefix is free of such joins: the one that the model's merges make. So the pieces are those of the
model's own encoder for either kind; only white space differs, which a model may be told to fold and which is kept here.

A character without a piece falls back to its UTF-8 bytes as one unit, at ``UNKNOWN`` below the least ordinary score.
U+2581 in a text is such a character (the model means a space by it), so decoding gives back every text exactly.

Defined results: null and empty texts have no pieces and decode to the empty text; very long texts and words are encoded
whole; pieces of equal score are taken longest last piece first (unigram) or leftmost merge first (BPE); rows that repeat
are encoded alike; columns beside id and text are not read; an empty table gives an empty table. The model's path is a
parameter; a file that is missing, or is no model, fails at once, on the driver.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import _arrow_schema, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: Scores at and below this are markers of pieces that training never chose, not ordinary scores.
NEVER = -1e8
#: Words, and joins of pieces, that a worker remembers.
REMEMBERED = 400_000
JOINS = 2_000_000
_CUT = re.compile(r" *[^ \n]+| +|\n")
_WHOLE = re.compile(r".+", re.S)


class Model(NamedTuple):
    """(piece, score, kind) of every id, and whether the model is of the BPE kind."""

    pieces: list[tuple[str, float, int]]
    merges: bool


class Pieces:
    """The vocabulary: pieces with spaces for marks, their scores, and the ids of the byte pieces."""

    def __init__(self, model: Model):
        pieces = model.pieces
        self.text = [b""] * len(pieces)
        self.byte_ids = [-1] * 256
        # Character -> [the piece that begins there, or None; nodes of the characters before].
        self.tails: dict = {}
        self.merges, self.score, self.plain, self.joins = model.merges, {}, [""] * len(pieces), {}
        ordinary = [s for _, s, kind in pieces if kind in (1, 4) and s > NEVER]
        self.unknown = (min(ordinary) if ordinary else 0.0) - UNKNOWN
        self.unk_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        crossing = False
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes((int(piece[3:5], 16),))
            elif kind in (1, 4):
                plain = piece.replace(MARK, " ")
                crossing |= "\n" in plain or " " in plain.lstrip(" ")
                self.text[i], self.plain[i], self.score[plain] = plain.encode(), plain, score
                node = self.tails
                for c in plain[:0:-1]:
                    node = node.setdefault(c, [None, {}])[1]
                if plain:
                    node.setdefault(plain[0], [None, {}])[0] = (i, score)
        self.cut = _WHOLE if crossing else _CUT

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if not model.pieces:
            raise ValueError(f"{path} is no SentencePiece model")
        return Model([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == 2)

    def merged(self, text: str, border: int = 0) -> list[str]:
        """What the model's merges make of a text: the best pair first, the leftmost of equals; nothing if one crosses the border."""
        parts, score, none = list(text), self.score.get, -math.inf
        pairs = [score(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs:
            top = max(pairs)
            if top == none:
                break
            at = pairs.index(top)
            if at < border:
                border -= 1
                if at == border:
                    return []
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def joins_well(self, before: int, piece: int) -> bool:
        """Whether the piece may follow the one before, -1 for none or a character without a piece."""
        key = before * len(self.text) + piece
        got = self.joins.get(key)
        if got is None:
            x, y = self.plain[before] if before >= 0 else "", self.plain[piece]
            got = self.merged(x + y, len(x)) == ([x, y] if x else [y])
            if len(self.joins) > JOINS:
                self.joins.clear()
            self.joins[key] = got
        return got

    def words(self, text: str | None) -> list[str]:
        return self.cut.findall(" " + text) if text else []

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """The ids of sorted distinct words, as packed 32-bit integers."""
        tails, unknown, merges, joins_well = self.tails, self.unknown, self.merges, self.joins_well
        known, size = self.joins.get, len(self.text)
        best, last, ids = [0.0], [0], [-1]
        out, before = [], ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], last[shared + 1 :], ids[shared + 1 :]
            for end in range(shared, len(word)):
                top, start, piece, hits = -math.inf, end, -1, []
                node, at = tails, end
                while at >= 0:
                    step = node.get(word[at])
                    if step is None:
                        break
                    hit, node = step
                    if hit is not None:
                        hits.append((at, hit))
                    at -= 1
                if merges:
                    # The longest that joins.
                    for at, hit in reversed(hits):
                        joins = known(ids[at] * size + hit[0])
                        if joins or joins is None and joins_well(ids[at], hit[0]):
                            top, start, piece = best[at] + hit[1], at, hit[0]
                            break
                else:
                    for at, hit in hits:
                        s = best[at] + hit[1]
                        if s >= top:
                            top, start, piece = s, at, hit[0]
                if piece < 0 or not merges and hits[0][0] < end:
                    s = best[end] + unknown
                    if s > top:
                        top, start, piece = s, end, -1
                best.append(top)
                last.append(start)
                ids.append(piece)
            got, at = [], len(word)
            while at > 0:
                if ids[at] >= 0:
                    got.append(ids[at])
                else:
                    for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")):
                        got.append(self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unk_id)
                at = last[at]
            got.reverse()
            out.append(array("i", got).tobytes())
            before = word
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw.decode("utf-8", "surrogatepass")[1:]


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[int]]:
        """The ids and the number of words of every text."""
        cut = [self.pieces.words(t) for t in texts]
        new = sorted({w for words in cut for w in words}.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = sorted({w for words in cut for w in words})
        self.known.update(zip(new, self.pieces.encode_sorted(new), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut], list(map(len, cut))


_last: list[tuple[str, Encoder]] = []


def encoder_of(key: str, model: Model) -> Encoder:
    """The encoder that an earlier task of the same query left in this worker, with what it remembers, or a new one."""
    if not _last or _last[0][0] != key:
        _last[:] = [(key, Encoder(Pieces(model)))]
    return _last[0][1]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, n_byte_pieces, ids, exact): ids of every whole text; exact: they decode to it."""
    spark = docs.sparkSession
    shipped, key = spark.sparkContext.broadcast(Pieces.load(model)), uuid.uuid4().hex
    schema = "doc_id long, n_words long, n_pieces long, n_byte_pieces long, ids array<int>, exact boolean"
    arrow = _arrow_schema(spark, schema)

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(key, shipped.value)
        pieces = encoder.pieces
        is_byte = np.zeros(len(pieces.text), bool)
        is_byte[[i for i in pieces.byte_ids if i >= 0]] = True
        for whole in batches:
            for batch in slices(whole, 8 << 20):
                texts = batch[text_col].to_pylist()
                got, n_words = encoder(texts)
                flat = np.concatenate(got) if got else np.empty(0, np.int32)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch[id_col].cast(pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([int(is_byte[g].sum()) for g in got], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(arrow.field("ids").type),
                        pa.array([pieces.decode(g.tolist()) == (t or "") for g, t in zip(got, texts, strict=True)]),
                    ],
                    schema=arrow,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    arrow = _arrow_schema(encoded.sparkSession, "doc_id long, text string")

    def run(batches):
        import pyarrow as pa

        pieces = Pieces(shipped.value)
        for batch in batches:
            texts = [pieces.decode(ids or ()) for ids in batch[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[id_col].cast(pa.int64()), pa.array(texts, pa.string())], schema=arrow)

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def op5_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
