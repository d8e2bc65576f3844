"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, which a forward algorithm gives in one sweep; a
text's score for a language is the sum of its words' logarithms. Piece probabilities come from
expectation maximisation over the words of a bounded, hash-chosen sample of labelled texts.

Words are runs of ASCII letters and bytes of other scripts, ASCII letters lower-cased, each preceded
by a space as the vocabulary expects; digits and punctuation only part words. Single bytes are pieces,
so every word has a segmentation. A long word, such as a sentence of a script without spaces, is cut
at the places that no piece in it spans: no segmentation reaches across, so its probability is exactly
the product of its stretches'. What is still long is summed in a rolling window as wide as the longest
piece, with its scale kept apart. Scoring touches each row once, without a shuffle; a worker keeps the
scores of words it has met, up to a fixed number.

Edge cases: a null text and one without a letter get ``und`` with score 0; ties between languages go
to the first in alphabetical order; without labelled rows everything is ``und``; repeated rows get
equal results; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import codes, small_batches, text_chunks, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
UNKNOWN = "und"
SHORT = 31  # bytes of words that are summed without a rolling window; results do not depend on it
CACHE_WORDS = 1 << 19


@dataclass
class PieceTrie:
    """The vocabulary as arrays: edges (node * 256 + byte, sorted), their targets and the piece that ends at a node, or -1."""

    edges: np.ndarray
    targets: np.ndarray
    piece: np.ndarray
    size: int
    longest: int

    @classmethod
    def load(cls, path: str = VOCABULARY) -> PieceTrie:
        pieces = [base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()]
        return cls.of(pieces)

    @classmethod
    def of(cls, pieces: list[bytes]) -> PieceTrie:
        pieces = list(dict.fromkeys([*pieces, *(bytes([b]) for b in range(256))]))
        child: dict[int, int] = {}
        ends = [-1]
        for number, text in enumerate(pieces):
            node = 0
            for byte in text:
                key = node * 256 + byte
                if key not in child:
                    child[key] = len(ends)
                    ends.append(-1)
                node = child[key]
            ends[node] = number
        keys = np.array(sorted(child), dtype=np.int64)
        return cls(keys, np.array([child[k] for k in keys.tolist()], dtype=np.int64), np.array(ends), len(pieces), max(map(len, pieces)))

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have an edge for their byte, and where those lead."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        found = self.edges[at] == key
        return found, self.targets[at[found]]

    def spans(self, text: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Every piece in every word, by start: (start, end, rows, pieces). ``text`` has a word a row."""
        for i in range(text.shape[1]):
            rows = np.flatnonzero(size > i)
            node = np.zeros(len(rows), dtype=np.int64)
            for k in range(i, text.shape[1]):
                found, node = self.step(node, text[rows, k])
                rows = rows[found]
                if not len(rows):
                    break
                piece = self.piece[node]
                has = piece >= 0
                if has.any():
                    yield i, k + 1, rows[has], piece[has]
                more = size[rows] > k + 1
                rows, node = rows[more], node[more]


    def stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, the long ones cut where no piece spans: bytes, starts, ends, whether a space goes before, and the text of each."""
        text_of = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
        lead = np.ones(len(starts), dtype=bool)
        long = np.flatnonzero(ends - starts > SHORT)
        if not len(long):
            return data, starts, ends, lead, text_of
        # the long words behind each other, each with its space
        size = ends[long] - starts[long] + 1
        stop = np.cumsum(size)
        begin = stop - size
        of = np.repeat(np.arange(len(long)), size)
        text = data[np.maximum(np.arange(stop[-1]) - begin[of] + starts[long][of] - 1, 0)]
        text[begin] = 32
        spanned = np.zeros(len(text) + 1, dtype=np.int64)
        at, node, until = np.arange(len(text)), np.zeros(len(text), dtype=np.int64), stop[of]
        depth = 0
        while len(at):
            found, node = self.step(node, text[at + depth].astype(np.int64))
            at, until = at[found], until[found]
            depth += 1
            if depth > 1:
                whole = at[self.piece[node] >= 0]
                np.add.at(spanned, whole + 1, 1)
                np.subtract.at(spanned, whole + depth, 1)
            more = at + depth < until
            at, node, until = at[more], node[more], until[more]
        cut = np.cumsum(spanned)[:-1] == 0
        cut[begin] = True
        own_starts = np.flatnonzero(cut)
        own_ends = np.append(own_starts[1:], len(text))
        rest = np.flatnonzero(ends - starts <= SHORT)
        base = len(data)
        return (
            np.concatenate([data, text, np.zeros(8, dtype=np.uint8)]),
            np.concatenate([starts[rest], own_starts + base]),
            np.concatenate([ends[rest], own_ends + base]),
            np.concatenate([lead[rest], np.zeros(len(own_starts), dtype=bool)]),
            np.concatenate([text_of[rest], text_of[long][of[own_starts]]]),
        )


def word_matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows, those with ``lead`` behind a space; and their sizes."""
    size = ends - starts + lead
    width = int(size.max()) if len(size) else 0
    at = np.clip(starts[:, None] - lead[:, None] + np.arange(width), 0, len(data) - 1)
    text = np.where(np.arange(width) < size[:, None], data[at], 0).astype(np.int64)
    text[lead, 0] = 32
    return text, size


def forward(trie: PieceTrie, probability: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probability of every prefix of every word, summed over segmentations: words x positions x languages."""
    alpha = np.zeros((len(size), text.shape[1] + 1, probability.shape[1]))
    alpha[:, 0] = 1
    for start, end, rows, piece in trie.spans(text, size):
        alpha[rows, end] += alpha[rows, start] * probability[piece]
    return alpha


def log_forward(trie: PieceTrie, probability: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The words' log probabilities from a rolling window of prefixes; a prefix of very small probability becomes the window's new scale."""
    width = trie.longest + 1
    window = np.zeros((len(size), width, probability.shape[1]))
    window[:, 0] = 1
    scale = np.zeros((len(size), probability.shape[1]))
    for i in range(text.shape[1]):
        rows = np.flatnonzero(size > i)
        small = rows[window[rows, i % width].min(axis=1) < 1e-100]
        if len(small):
            here = window[small, i % width]
            scale[small] += np.log(here)
            window[small] /= here[:, None]
        here = window[:, i % width].copy()
        window[rows, i % width] = 0  # the place of a prefix to come
        node = np.zeros(len(rows), dtype=np.int64)
        for k in range(i, text.shape[1]):
            found, node = trie.step(node, text[rows, k])
            rows = rows[found]
            if not len(rows):
                break
            piece = trie.piece[node]
            has = piece >= 0
            window[rows[has], (k + 1) % width] += here[rows[has]] * probability[piece[has]]
            more = size[rows] > k + 1
            rows, node = rows[more], node[more]
    return scale + np.log(window[np.arange(len(size)), size % width])


def log_probability(trie: PieceTrie, probability: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, block: int = 20000) -> np.ndarray:
    """Words' log probabilities in each language, in blocks of words of like length."""
    out = np.zeros((len(starts), probability.shape[1]))
    order = np.argsort(ends - starts, kind="stable")
    short = int(np.searchsorted((ends - starts)[order], SHORT, side="right"))
    for k in range(0, short, block):
        own = order[k : min(k + block, short)]
        text, size = word_matrix(data, starts[own], ends[own], lead[own])
        alpha = forward(trie, probability, text, size)
        out[own] = np.log(alpha[np.arange(len(own)), size])
    step = max(1, (1 << 21) // ((trie.longest + 1) * max(1, probability.shape[1])))
    k = short
    while k < len(order):
        own = order[k : k + step]
        own = own[: max(1, int(np.searchsorted((ends - starts)[own], 2 * (ends - starts)[own[0]], side="right")))]
        out[own] = log_forward(trie, probability, *word_matrix(data, starts[own], ends[own], lead[own]))
        k += len(own)
    return out


def expected_counts(trie: PieceTrie, probability: np.ndarray, text: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) in each language (columns); weight: words x languages."""
    alpha = forward(trie, probability, text, size)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(size)), size] = 1
    total = alpha[np.arange(len(size)), size]
    used = list(trie.spans(text, size))
    for start, end, rows, piece in reversed(used):
        beta[rows, start] += beta[rows, end] * probability[piece]
    counts = np.zeros_like(probability)
    for start, end, rows, piece in used:
        share = alpha[rows, start] * probability[piece] * beta[rows, end] / total[rows] * weight[rows]
        for j in range(share.shape[1]):
            counts[:, j] += np.bincount(piece, share[:, j], minlength=len(counts))
    return counts


@dataclass
class LanguageModel:
    """Languages in alphabetical order, log priors, piece probabilities (pieces x languages) and the vocabulary's trie."""

    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray
    trie: PieceTrie


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, max_words: int = 20000, rounds: int = 3, vocabulary: str = VOCABULARY, smoothing: float = 0.05) -> LanguageModel:
    """Learn from a sample of about ``max_docs`` labelled texts, chosen by a hash of the text, and each language's ``max_words`` commonest words in it.

    Stretches of long words that no cut brings under 256 bytes are not learned from.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language, as the model has a column a language
    languages = sorted(per_lang)
    trie = PieceTrie.load(vocabulary)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((trie.size, 0)), trie)
    # every language gets its share of the sample, so that a rare one is not lost beside a common one
    share = max_docs / len(languages)
    chance = labelled.sparkSession.createDataFrame([(lang, min(1.0, share / n)) for lang, n in per_lang.items()], "lang string, chance double")
    sample = rows.join(F.broadcast(chance), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("chance") * (1 << 20)).drop("chance")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in text_chunks(batch["text"]):
                data, starts, ends, _, first = words(chunk, punctuation=True, digits=False)
                lang = batch["lang"].slice(at, len(chunk)).to_pylist()
                data, begin, end, lead, text_of = trie.stretches(data, starts, ends, first)
                keys: dict[tuple[str, bytes], int] = {}
                raw = data.tobytes()
                for a, b, space, t in zip(begin.tolist(), end.tolist(), lead.tolist(), text_of.tolist()):
                    if b - a < 256:
                        key = lang[t], b" " + raw[a:b] if space else raw[a:b]
                        keys[key] = keys.get(key, 0) + 1
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.binary()), "n": pa.array(list(keys.values()), pa.int64())}
                )

    counts = sample.mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = counts.withColumn("nth", nth).where(F.col("nth") <= max_words).select("lang", "word", "n").toArrow()
    found = common["word"].to_pylist()
    distinct = {w: k for k, w in enumerate(dict.fromkeys(found))}
    weight = np.zeros((len(distinct), len(languages)))
    column = {lang: k for k, lang in enumerate(languages)}
    for word, lang, n in zip(found, common["lang"].to_pylist(), common["n"].to_pylist()):
        weight[distinct[word], column[lang]] = n
    data = np.frombuffer(b"".join(distinct) + bytes(8), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in distinct]).astype(np.int64)
    starts = ends - np.array([len(w) for w in distinct], dtype=np.int64)
    probability = np.full((trie.size, len(languages)), 1.0 / trie.size)
    order = np.argsort(ends - starts, kind="stable")
    for _ in range(rounds):
        uses = np.zeros_like(probability)
        for k in range(0, len(order), 10000):
            own = order[k : k + 10000]
            text, size = word_matrix(data, starts[own], ends[own], np.zeros(len(own), dtype=bool))  # spaces are among their bytes
            uses += expected_counts(trie, probability, text, size, weight[own])
        probability = (uses + smoothing) / (uses.sum(axis=0) + smoothing * trie.size)
    seen = np.array([per_lang[lang] for lang in languages], dtype=float)
    return LanguageModel(languages, np.log(seen / seen.sum()), probability, trie)


def score(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # vocabulary and vocabulary x languages numbers: bounded
    docs = docs.drop("lang_pred", "score")  # an earlier prediction is replaced
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, scores = np.zeros(0, dtype=np.uint64), np.zeros((0, len(model.languages)))
        for batch in batches:
            picked = np.full(batch.num_rows, -1)
            posterior = np.zeros(batch.num_rows)
            for at, chunk in text_chunks(batch[text_col]) if model.languages else ():
                lower, starts, ends, _, first = words(chunk, punctuation=True, digits=False)
                data, begin, end, lead, text_of = model.trie.stretches(lower, starts, ends, first)
                code = codes(data, begin, end) ^ np.where(lead, 0, 0x9E3779B97F4A7C15).astype(np.uint64)
                unique, where, inverse = np.unique(code, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                seen = known[place] == unique if len(known) else np.zeros(len(unique), dtype=bool)
                own = np.empty((len(unique), len(model.languages)))
                own[seen] = scores[place[seen]]
                new = where[~seen]
                own[~seen] = log_probability(model.trie, model.probability, data, begin[new], end[new], lead[new])
                if len(known) + len(new) > CACHE_WORDS:
                    known, scores = unique[:CACHE_WORDS], own[:CACHE_WORDS]
                elif len(new):
                    both = np.concatenate([known, unique[~seen]])
                    order = np.argsort(both)
                    known, scores = both[order], np.concatenate([scores, own[~seen]])[order]
                total = np.stack([np.bincount(text_of, own[inverse, j], minlength=len(chunk)) for j in range(own.shape[1])], axis=1) + model.prior
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                letters = _ascii_letters(lower, chunk)
                for k in np.flatnonzero(~letters).tolist():
                    letters[k] = any(c.isalpha() for c in chunk[k].as_py())
                picked[at : at + len(chunk)] = np.where(letters, best, -1)
                posterior[at : at + len(chunk)] = np.where(letters, sure, 0)
            names = [model.languages[k] if k >= 0 else UNKNOWN for k in picked.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(posterior)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def _ascii_letters(data: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Which texts hold an ASCII letter; ``data`` is their lower-cased bytes."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    sums = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    return sums[ends[1:] - ends[0]] > sums[ends[:-1] - ends[0]]


def held_out(doc_id="doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def accepted(scored: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least ``min_score``."""
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
