"""Chat formatting with a loss mask aligned to token offsets.

A conversation is rendered whole and encoded once with offsets (a token's length in bytes is known, so
offsets are running sums), and the sorted spans of the trained turns are intersected with the token
spans by binary search. Texts cannot forge a turn: control strings inside them get a backslash, which
unescape() takes out again.

Rows are dealt by conversation and streamed in turn order, so that a task holds one part at a time.
A conversation of more than ``part_chars`` rendered characters is given out in parts cut between
turns; the control strings are tokens of their own, so the parts' tokens are those of the whole.

Edge cases: a null text counts as empty; a null or unknown role gets a marked turn of its own; rows
of one turn number come in order of role and text, nulls first; repeated rows are repeated turns; a
null conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A turn's marks are tokens of their own with their white space, so that no token reaches from a mark into a text.
OPEN = {"user": "[INST] ", "assistant": "<s>", "system": "<<SYS>>\n"}
CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": "\n<</SYS>>"}
OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE = "<<TURN>>", "<</ROLE>>", "<</TURN>>"
MARKS = [*OPEN.values(), *CLOSE.values(), OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE]
CONTROL = [mark.strip() for mark in MARKS]
_ESCAPE = re.compile("([<\\[])(\\\\*)(" + "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True)) + ")")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART_CHARS = 1 << 20

SCHEMA = "conv_id long, part int, text string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's text and the span of the escaped text in it."""
    body = escape(text or "")
    head = OPEN.get(role or "") or f"{OTHER_OPEN}{escape(role or '')}{OTHER_ROLE}"
    return head + body + CLOSE.get(role or "", OTHER_CLOSE), len(head), len(head) + len(body)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    at = 0
    while at < len(text):
        role = next((r for r, mark in OPEN.items() if text.startswith(mark, at)), None)
        if role is None:
            if not text.startswith(OTHER_OPEN, at):
                raise ValueError(f"no turn begins at character {at}")
            to = text.index(OTHER_ROLE, at)
            role, start, mark = unescape(text[at + len(OTHER_OPEN) : to]), to + len(OTHER_ROLE), OTHER_CLOSE
        else:
            start, mark = at + len(OPEN[role]), CLOSE[role]
        end = text.index(mark, start)
        yield role, unescape(text[start:end])
        at = end + len(mark)


class Tokenizer:
    """Byte-level pairs with the control strings as tokens of their own, after the vocabulary's."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        known = {base64.b64decode(token): int(rank) for token, rank in pairs}
        first = max(known.values()) + 1
        control = {c: first + k for k, c in enumerate(MARKS)}
        self.coder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=known, special_tokens=control)
        self.bytes = [b""] * (first + len(MARKS))
        for token, rank in [*known.items(), *((c.encode(), k) for c, k in control.items())]:
            self.bytes[rank] = token
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Tokens, and the byte offset at which each ends."""
        ids = self.coder.encode(text, allowed_special="all")
        return ids, np.cumsum(self.size[ids]) if ids else np.zeros(0, dtype=np.int64)

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")


@lru_cache(2)
def _tokenizer(ranks: bytes) -> Tokenizer:
    return Tokenizer(ranks)


def byte_spans(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character spans, sorted and disjoint, as byte spans."""
    if text.isascii():
        return np.array(spans, dtype=np.int64).reshape(-1, 2)
    lead = np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80
    starts = np.append(np.flatnonzero(lead), len(lead))
    return starts[np.array(spans, dtype=np.int64).reshape(-1, 2)]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint spans."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    k = np.searchsorted(spans[:, 1], starts, side="right")  # the first span that ends after the token begins
    near = spans[np.minimum(k, len(spans) - 1)]
    return (k < len(spans)) & (near[:, 0] < ends) & (starts < ends)


def _parts(rows: Iterator[tuple], train: frozenset, limit: int) -> Iterator[tuple]:
    """(conv_id, part, text, trained spans) from rows in order."""
    conv, part, texts, spans, size, begun = None, 0, [], [], 0, False
    for conv_id, role, text in rows:
        turn, a, b = render(role, text)
        if begun and (conv_id != conv or size + len(turn) > limit and size):
            yield conv, part, "".join(texts), spans
            part = part + 1 if conv_id == conv else 0
            texts, spans, size = [], [], 0
        if role in train and a < b:
            spans.append((size + a, size + b))
        texts.append(turn)
        size += len(turn)
        conv, begun = conv_id, True
    if begun:
        yield conv, part, "".join(texts), spans


def format_conversations(conversations: DataFrame, train_roles: tuple[str, ...] = ("assistant",), tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation (or part of a very long one): the text, its tokens, the loss mask over tokens and the trained spans."""
    train = frozenset(train_roles)
    spec = conversations.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(spec.value)
        rows = ((c, r, t) for b in batches for c, r, t in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()))
        pending, size = [], 0

        def flush():
            ids, masks = [], []
            for _, _, text, spans in pending:
                tokens, ends = coder.encode(text)
                ids.append(tokens)
                masks.append(token_mask(ends - coder.size[tokens], ends, byte_spans(text, spans)).tolist() if tokens else [])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pending], pa.int64()),
                    pa.array([p[1] for p in pending], pa.int32()),
                    pa.array([p[2] for p in pending], pa.string()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(masks, pa.list_(pa.bool_())),
                    pa.array([[{"start": a, "end": b} for a, b in p[3]] for p in pending], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["conv_id", "part", "text", "input_ids", "loss_mask", "loss_spans"],
            )

        for p in _parts(rows, train, part_chars):
            pending.append(p)
            size += len(p[2])
            if size >= part_chars:
                yield flush()
                pending, size = [], 0
        if pending:
            yield flush()

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(encode, SCHEMA)


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER, in_order: bool = False) -> DataFrame:
    """What the formatted rows say, per conversation: turns and trained text as digests. The rows may come in any order; ``in_order`` says that they are still as format_conversations() gave them."""
    spec = formatted.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(spec.value)
        state, done = None, []

        def rows():
            return pa.RecordBatch.from_pylist(done, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())]))

        def close():
            conv, n, turns, chars, loss, total, tokens = state
            done.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total, "n_tokens": tokens})

        for batch in batches:
            for conv, part, text, ids, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "text", "input_ids", "loss_mask"))):
                if state is None or part == 0:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                on = np.flatnonzero(np.diff(np.array([False, *mask, False], dtype=np.int8)))
                for a, b in zip(on[::2].tolist(), on[1::2].tolist()):
                    under = unescape(coder.text(ids[a:b]))
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(text)
                state[6] += len(ids)
            if len(done) >= 5000:
                yield rows()
                done = []
        if state is not None:
            close()
        if done:
            yield rows()

    dealt = formatted.select("conv_id", "part", "text", "input_ids", "loss_mask")
    if not in_order:
        dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
