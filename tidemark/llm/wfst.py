"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser rewrites characters (space to U+2581) and
puts one mark in front. The pieces are a machine of one state with an arc for each piece, which reads its
characters and writes it at its weight; a character that no piece covers passes by way of its bytes.
The acceptor says in which order pieces may come: its states are the
last pieces, its arcs the next ones, with a weight.

The machines are composed with an input lazily: a state of the composition is a place in the text and a
state of the acceptor, and only states that some path reaches at finite weight are made. The encoding
is the path of least weight, found by relaxing the arcs into each place in order of the places (sums
along a path, the least among paths: the tropical semiring). Among paths of one weight the one whose last piece is
longest wins, and so on towards the front.

For a byte-pair model pieces weigh 0, and the acceptor's weight between two pieces is 0 where merging by
score leaves their boundary standing and infinite where it does not: a sequence is what merging yields
if and only if every neighbouring pair is, so one path of finite weight reaches each place, and the first
one that is found to the end, depth first, is the least. For a unigram model pieces weigh their negative score and every order is free.

A text is cut at places that no piece can span, so equal segments are solved once; a worker keeps a
bounded number of them. No shuffle.

Edge cases: a null text has null tokens, an empty one none; U+2581 in a text decodes to a space, as
in the library; long segments are solved without being kept; repeated rows get equal results; an
empty table gives an empty result; other columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
KEPT_SEGMENTS = 1 << 18
KEPT_LENGTH = 48
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


INFINITE = float("inf")


class Normaliser:
    """One state: an arc for each rewritten character, none of which is written by another arc; all others pass as they are; the way in writes ``prefix``."""

    def __init__(self, arcs: dict[str, str], prefix: str):
        self.arcs, self.prefix = arcs, prefix

    def __call__(self, text: str) -> str:
        for c, out in self.arcs.items():
            text = text.replace(c, out)
        return self.prefix + text if text else ""


class Pieces:
    """One state, with an arc back to itself for each piece: it reads the piece's characters and writes the piece at its weight."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.longest = max(map(len, weights), default=1)
        # the length of the longest piece that begins with so many characters
        self.reach: dict[str, int] = {}
        for piece in weights:
            self.reach[piece[:2]] = max(self.reach.get(piece[:2], 1), len(piece))
        # the arc of a character without a piece of its own costs more than any piece
        self.uncovered = max([0.0, *weights.values()]) + 10.0


class FreeOrder:
    """The acceptor of a unigram model: one state, every piece may follow at no weight."""

    one_path = False

    def arc(self, state: str, piece: str) -> tuple[str, float]:
        return "", 0.0


class MergeOrder:
    """The acceptor of a byte-pair model. Its states are the last pieces; arcs are made when first asked for, by merging the pair's characters."""

    one_path = True  # reaches each place at finite weight

    def __init__(self, score: dict[str, float]):
        self.score = score
        self.weights: dict[tuple[str, str], float] = {}

    def merged(self, text: str) -> list[str]:
        """Merging neighbours whose union is the piece of highest score, the leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1)), default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def arc(self, state: str, piece: str) -> tuple[str, float]:
        if not state:
            return piece, 0.0
        weight = self.weights.get((state, piece))
        if weight is None:
            if len(self.weights) > 1 << 20:
                self.weights.clear()
            weight = self.weights[state, piece] = 0.0 if self.merged(state + piece) == [state, piece] else INFINITE
        return piece, weight


def shortest_path(text: str, pieces: Pieces, order: FreeOrder | MergeOrder) -> tuple[float, list[str]]:
    """The least weight of a path through the composition of ``text`` with the two machines, and its pieces."""
    if order.one_path:
        return only_path(text, pieces, order)
    n, weights = len(text), pieces.weights
    # at each place: state of the acceptor -> (weight, where its last piece began, the state there, that piece)
    reached: list[dict[str, tuple]] = [{"": (0.0, 0, "", "")}]
    for end in range(1, n + 1):
        there: dict[str, tuple] = {}
        for start in range(end - 1, max(-1, end - pieces.longest - 1), -1):
            piece = text[start:end]
            weight = weights.get(piece, pieces.uncovered if start == end - 1 else INFINITE)
            if weight == INFINITE:
                continue
            for state, known in reached[start].items():
                after, extra = order.arc(state, piece)
                total = known[0] + weight + extra
                # pieces come longer and longer, so of equal weights the last has the longest last piece
                if total < INFINITE and (after not in there or total <= there[after][0]):
                    there[after] = (total, start, state, piece)
        reached.append(there)
    if not n:
        return 0.0, []
    state, (total, start, before, piece) = min(reached[n].items(), key=lambda x: (x[1][0], x[1][1]))
    out = [piece]
    while start:
        _, start, before, piece = reached[start][before]
        out.append(piece)
    return total, out[::-1]


def only_path(text: str, pieces: Pieces, order: MergeOrder) -> tuple[float, list[str]]:
    """The same where one path of finite weight reaches each place, so that the first one found to the end is the least.

    Pieces are tried depth first, the longest first. A place from which no arc leads on is not entered again: one path reaches it.
    """
    n, weights, reach, known = len(text), pieces.weights, pieces.reach, order.weights
    out, at, last, dead = [], 0, "", set()
    length = min(reach.get(text[:2], 1), n)
    while at < n:
        while length:
            piece = text[at : at + length]
            if (piece in weights or length == 1) and at + length not in dead:
                extra = known.get((last, piece)) if last else 0.0
                if extra is None:
                    extra = order.arc(last, piece)[1]
                if extra < INFINITE:
                    break
            length -= 1
        if length:
            out.append(piece)
            at, last = at + length, piece
            length = min(reach.get(text[at : at + 2], 1), n - at)
        else:
            dead.add(at)
            length = len(out.pop())
            at, last = at - length, out[-1] if out else ""
            length -= 1
    return sum([weights.get(piece, pieces.uncovered) for piece in out], 0.0), out


class Transducer:
    """Compiled from the bytes of a byte-pair or unigram model with byte fallback and the identity normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type not in (1, 2) or not trained.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only byte-pair and unigram models with byte fallback and the identity normaliser")
        self.normaliser = Normaliser({" ": SPACE}, SPACE if rules.add_dummy_prefix else "")
        score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.byte = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.surface = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else " \u2047 ".encode() if p.type == _UNKNOWN else b""
            for p in proto.pieces
        ]
        if trained.model_type == 2:
            self.order = MergeOrder(score)
            # pieces that merging their own characters never yields have no arcs
            self.pieces = Pieces({p: 0.0 for p in score if self.order.merged(p) == [p]})
        else:
            self.order, self.pieces = FreeOrder(), Pieces({p: -s for p, s in score.items()})
        self.solved: dict[str, bytes] = {}
        self.segments = re.compile(self._segments(list(score)), re.S)

    @staticmethod
    def _segments(pieces: list[str]) -> str:
        """A pattern that cuts a text only where no piece reaches across: before spaces, around line feeds, between letters and others."""
        numbers = "".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letters, others = rf"[^\W\d_{re.escape(numbers)}]", rf"[\W\d_{re.escape(numbers)}]"
        letter = re.compile(letters)
        bare = [p.lstrip(SPACE) for p in pieces]
        mixed = any(bool(letter.match(x)) != bool(letter.match(y)) for p in bare for x, y in zip(p, p[1:]))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return ".+"
        if any("\n" in p and len(p) > 1 for p in pieces):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        if mixed:
            return f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        return rf"\n|{SPACE}*{letters}+|{SPACE}*(?:(?![{SPACE}\n]){others})+|{SPACE}+"

    def solve(self, segment: str) -> bytes:
        """The segment's tokens as 32-bit numbers."""
        ids: list[int] = []
        for piece in shortest_path(segment, self.pieces, self.order)[1]:
            known = self.id.get(piece)
            if known is None:
                ids += [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                ids.append(known)
        return array("i", ids).tobytes()

    def encoded(self, text: str) -> bytes:
        """The tokens of a text as 32-bit numbers."""
        if not text:
            return b""
        solved = self.solved
        segments = self.segments.findall(self.normaliser(text))
        found = list(map(solved.get, segments))
        if None in found:
            if len(solved) >= KEPT_SEGMENTS:
                solved.clear()
            for k, ids in enumerate(found):
                if ids is None:
                    segment = segments[k]
                    ids = found[k] = solved.get(segment) or self.solve(segment)
                    if len(segment) <= KEPT_LENGTH:
                        solved[segment] = ids
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text


@lru_cache(2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _with(df: DataFrame, column: T.StructField) -> tuple[DataFrame, T.StructType]:
    df = df.drop(column.name)
    return df, T.StructType([*df.schema.fields, column])


def encode(docs: DataFrame, text_col: str = "text", to: str = "input_ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the tokens of each text."""
    small_batches(docs.sparkSession)
    docs, schema = _with(docs, T.StructField(to, T.ArrayType(T.IntegerType())))
    spec = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(spec.value)
        for batch in batches:
            valid = batch[text_col].is_valid()
            for at, chunk in text_chunks(batch[text_col]):
                found = [machine.encoded(t) for t in chunk.to_pylist()]
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                flat = np.frombuffer(b"".join(found), dtype=np.int32)
                offsets = pa.array(cuts, pa.int32(), mask=np.append(~valid.slice(at, len(chunk)).to_numpy(zero_copy_only=False), False))
                part = batch.slice(at, len(chunk))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "input_ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text of each list of tokens."""
    tokens, schema = _with(tokens, T.StructField(to, T.StringType()))
    spec = tokens.sparkSession.sparkContext.broadcast(open(model, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(spec.value)
        for batch in batches:
            column, texts = batch[ids_col], []
            for k in range(len(column)):
                ids = column[k].values
                texts.append(None if ids is None else machine.decode(ids.to_numpy(zero_copy_only=False).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return tokens.mapInArrow(run, schema)
