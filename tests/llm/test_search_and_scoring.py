"""Lexical search, source divergence and language-model scoring against plain references."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, impact, pitmanyor
from tidemark.llm.common import Stored, same_bytes

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- lexical search


def ranked(docs, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    terms = [(d, cut(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    asked = defaultdict(list)
    for item, text in items:
        asked[item] += cut(text)
    out = []
    for item, words in asked.items():
        scored = []
        for doc, t in terms:
            tf, m = Counter(t), 100 - 25 + 25 * len(t) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in words if tf[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, nth, doc, -negative) for nth, (negative, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(1, "the cat, the Cat"), (2, "a cat sat"), (3, None), (4, ""), (5, "a cat sat"), (5, "a cat sat"), (None, "a cat sat"), (6, "…Ünïted 42 über"), (7, "?! --"), (8, "cat " * 3000), (9, "CAT x" + "y" * 70)]
ITEMS = [(0, "cat sat sat"), (1, None), (2, "nowhere"), (3, "über 42 Ünïted"), (0, "the"), (4, "x" + "y" * 70), (None, "cat")]


@pytest.mark.parametrize("block_docs,max_terms", [(1 << 15, 1 << 20), (2, 1 << 20), (3, 2)])
def test_search_equals_plain_ranking(spark, block_docs, max_terms):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, score int").repartition(2)
    items = spark.createDataFrame([(d, t, "z") for d, t in ITEMS], "item_id long, text string, doc_id string")
    got = impact.search(docs, items, k=3, max_terms=max_terms, block_docs=block_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == ranked(DOCS, ITEMS, 3)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact.search(docs.limit(0), items).count() == 0
    assert impact.search(docs, items.limit(0)).count() == 0
    assert impact.search(docs.where("doc_id in (3, 4, 7)"), items).count() == 0


def test_carries_and_descending_slices():
    rng = np.random.default_rng(1)
    n = 300
    values = rng.integers(0, 1 << 20, (6, n))
    total = np.zeros((30, -(-n // 64)), dtype=np.uint64)
    for k, v in enumerate(values):
        packed = np.zeros((20, total.shape[1] * 64), dtype=np.uint8)
        packed[:, :n] = (v >> np.arange(20)[:, None]) & 1
        impact.add(total, np.arange(total.shape[1]), np.packbits(packed, axis=1, bitorder="little").view(np.uint64), shift=k % 3)
    sums = (values << (np.arange(6) % 3)[:, None]).sum(axis=0)
    sums[50:90] = sums[50]
    exact = np.zeros((30, total.shape[1] * 64), dtype=np.uint8)
    before = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")
    assert (before[:, :50] == (sums[:50] >> np.arange(30)[:, None]) & 1).all()
    exact[:, :n] = (sums >> np.arange(30)[:, None]) & 1
    bits = np.packbits(exact, axis=1, bitorder="little").view(np.uint64)
    for k in (1, 5, 60, 299, 300, 400):
        want = np.lexsort((np.arange(n), -sums))[:k]
        assert set(impact.best(bits, n, k).tolist()) == set(want.tolist())


def test_equal_codes_are_compared_byte_by_byte():
    data = np.frombuffer(b"abcdefghij abcdefghix" + bytes(8), dtype=np.uint8)
    at = np.array([0, 0, 0]), np.array([10, 10, 3])
    to = np.array([11, 0, 11]), np.array([21, 10, 14])
    assert same_bytes(data, *at, data, *to).tolist() == [False, True, True]


# ---- divergence


def audited(rows, min_docs=10, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
    groups, in_docs = defaultdict(Counter), Counter()
    for text, lang, source in [tuple(v or "" for v in r) for r in rows]:
        groups[lang, source].update(cut(text))
        in_docs.update({(lang, w) for w in cut(text)})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (of, w), n in in_docs.items() if of == lang and n >= min_docs]
        share = lambda c: (lambda n: {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept})(sum(c[w] for w in kept))
        sources = {s: share(c) for (of, s), c in groups.items() if of == lang}
        whole = share(sum((c for (of, _), c in groups.items() if of == lang), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in sources.items():
            parts = {"pair": [(o, sum(f(p[w], q[w]) for w in kept)) for o, q in sources.items() if o != s]}
            parts["term"] = [(w, f(p[w], whole[w])) for w in kept if groups[lang, s][w] and p[w] > whole[w]]
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, nth) for nth, (item, value) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out, key=str)


def test_divergence_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    words = ["Ümlaut", "cat", "CAT2x", "dog", "it's", "ähm", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rng.choice(words[: 8 + 4 * (k % 5)], rng.integers(1, 30))), ("en", "de", None)[k % 3], f"s{k % 4}") for k in range(120)]
    rows += [(None, "en", "silent"), ("", None, None), ("12 ?", "xx", "a"), ("lonely words", "xx", "b"), ("rare", "yy", "only")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "text string, lang string, source string, value int").repartition(3)
    assert rows_of(divergence.audit(df, min_docs=5)) == audited(rows, 5)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", 20)
    rows = [(f"w{chr(97 + k % 26)} x{chr(97 + k % 7)} y{chr(97 + k % 11)}", "en", f"s{k % 5}") for k in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.audit(df, min_docs=3)) == audited(rows, 3)


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b))
    data, starts, ends, text_of = divergence.cut_terms(pa.array(["ab cd ab", "", "cd x9é"], pa.large_string()))
    group, sample = divergence.grouped(data, starts, ends)
    spelled = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert spelled == ["ab", "cd", "ab", "cd", "x", "é"] and text_of.tolist() == [0, 0, 0, 2, 2, 2]
    assert [spelled[k] for k in sample[group]] == spelled and len(set(group.tolist())) == 4


def test_shares_do_not_leave_64_bits():
    n, total = np.array([0, 5, 10**15]), 4 * 10**15
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (c + 2) // total for c in n.tolist()]


# ---- language model


def seatings(n):
    """Sizes of the tables of every seating of n customers."""
    if not n:
        yield ()
        return
    for rest in seatings(n - 1):
        yield (*rest, 1)
        for k in range(len(rest)):
            yield (*rest[:k], rest[k] + 1, *rest[k + 1 :])


def test_stirling_numbers_count_weighted_seatings():
    d = 0.3
    table = pitmanyor.stirling_table(d, 8)
    want = defaultdict(float)
    for sizes in seatings(6):
        want[len(sizes)] += math.prod(math.prod(k - d for k in range(1, s)) for s in sizes)
    assert np.allclose([math.exp(table[6, t]) for t in range(1, 7)], [want[t] for t in range(1, 7)])


@pytest.mark.parametrize("d", [0.1, 0.5, 0.9])
@pytest.mark.parametrize("mass", [0.01, 1.0, 20.0, 300.0])
def test_large_dishes_follow_the_recurrence(d, mass):
    n, t = 256, np.arange(1, 257)
    exact = pitmanyor.stirling_table(d)[n, 1:] + t * math.log(mass)
    near = pitmanyor.log_stirling(np.array([n]), t[None, :], d)[0] + t * math.log(mass)
    p, q = np.exp(exact - exact.max()), np.exp(near - near.max())
    p, q = p / p.sum(), q / q.sum()
    assert abs((p * t).sum() - (q * t).sum()) < 0.05 * (p * t).sum() + 0.1
    assert abs(pitmanyor.likeliest(np.array([float(n)]), np.array([mass]), d)[0] - t[p.argmax()]) <= 2 + 0.1 * t[p.argmax()]


def test_drawn_tables_follow_their_distribution():
    d, n, mass = 0.4, 7, 0.8
    table = pitmanyor.stirling_table(d)
    u = (np.arange(20000) + 0.5) / 20000
    got = np.bincount(pitmanyor.draw_tables(np.full(20000, n), np.full(20000, mass), u, d, table), minlength=8)[1:] / 20000
    want = np.exp(table[n, 1:8] + np.arange(1, 8) * math.log(mass))
    assert np.abs(got - want / want.sum()).max() < 1e-3
    big = pitmanyor.draw_tables(np.array([1, 0, 10**6, 10**9]), np.array([1.0, 1.0, 0.05, 2000.0]), np.full(4, 0.5), d, table)
    assert big[:2].tolist() == [1, 0] and 1 <= big[2] < 10 and 1000 < big[3] < 10**6


def test_log_gamma():
    x = np.array([0.02, 0.5, 1.0, 2.5, 10.0, 1e6])
    assert np.allclose(pitmanyor.log_gamma(x), [math.lgamma(v) for v in x])


TEXTS = [(k, " ".join(f"w{(k * j * j + j) % 11}" for j in range(40)), None) for k in range(60)]
ODD = [(100, None), (101, ""), (102, "never seen words"), (103, "w1 " * 9000), (5, TEXTS[5][1]), (5, TEXTS[5][1]), (None, "w1 w2"), (104, "W1\tw2\x0bw3  ")]


def lm_rows(spark):
    rows = [(d, t, "x") for d, t, _ in TEXTS] + [(d, t, "x") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("held_out", pitmanyor.held_out()).repartition(3)


def test_lm_base_counts_and_edges(spark):
    got = pitmanyor.score_corpus(lm_rows(spark), slices=3)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    every = [(d, cut(t)) for d, t, _ in TEXTS] + [(d, cut(t)) for d, t in ODD]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in every if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(d, out(d), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in every]
    assert sorted(((*r[:5], round(r[5], 6)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in got.collect())
    same = {r["score"] for r in got.where("doc_id = 5").collect()}
    assert len(same) == 1


def test_lm_prediction_sums_to_one_and_equals_the_formula(spark):
    """Over all words and the unknown one, each context's prediction sums to one; copies of what was learned score better than base."""
    docs = lm_rows(spark).select("doc_id", "text", "held_out")
    stored = Stored(spark)
    model = pitmanyor.fit(docs, stored, slices=2, sweeps=2)
    words = {r["w"]: r for r in model.words.collect()}
    contexts = {r["u"]: r for r in model.contexts.collect()}
    unknown = np.array(model.unknown)
    assert np.allclose(sum(np.array(r["share"]) for r in words.values()) + unknown, 1)
    pairs = [r for p in model.pairs for r in p.collect()]
    found = {r["code"]: r for part in range(2) for r in model.predictions(part).collect()}
    chance = lambda u, w: 10 ** found[int(pitmanyor.pair_code(*(np.array([x]).view(np.uint64) for x in (u, w)))[0].view(np.int64))]["score"]
    for u, context in contexts.items():
        c, tables = context["c"], np.array(context["tables"])
        back = lambda share: ((model.s + model.d * tables) / (model.s + c) * share).mean()
        seen = {r["w"] for r in pairs if r["u"] == u}
        total = sum(chance(u, w) for w in seen if w in words) + sum(back(np.array(r["share"])) for w, r in words.items() if w not in seen) + back(unknown)
        assert math.isclose(total, 1, rel_tol=1e-9), (u, total)


def test_lm_of_nothing(spark):
    docs = lm_rows(spark)
    assert pitmanyor.score_corpus(docs.limit(0), slices=2).count() == 0
    none = pitmanyor.score_corpus(docs.where("held_out"), slices=2, sweeps=1).collect()
    assert {(r["train_tokens"], r["base_score"], round(r["score"], 9)) for r in none} == {(0, 0.0, 0.0)}


def test_lm_moves_fewer_rows_than_there_are_tokens(spark):
    """Pairs, tokens and their predictions travel between tasks in packed rows, not one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).select("doc_id", "text", pitmanyor.held_out().alias("held_out")).repartition(2)
    store, context = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    moved = lambda: sum(s.shuffleWriteRecords() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))
    before = moved()
    tokens = sum(r["n_tokens"] for r in pitmanyor.score_corpus(docs).collect())
    context._jsc.sc().listenerBus().waitUntilEmpty()
    assert tokens > 50000 and moved() - before < tokens / 4


@pytest.mark.parametrize("side", [1, 3])
def test_lm_cells_hold_every_pair_and_its_count(spark, side):
    docs = lm_rows(spark).select("doc_id", "text", "held_out").repartition(4)
    blocks = pitmanyor.block_rows(docs, side, 2).where("what like 'pairs-%'")
    model_cells = pitmanyor.cells(blocks).collect()
    got = Counter()
    for r in model_cells:
        us, ws, runs, iw, n = (pitmanyor.unpacked(pa.scalar(bytes(r[k]), pa.binary())) for k in ("us", "ws", "runs", "iw", "n"))
        for u, w, k in zip(np.repeat(us, runs).tolist(), ws[iw].tolist(), n.tolist()):
            assert (u, w) not in got
            got[u, w] = k
    want = Counter()
    for r in lm_rows(spark).collect():
        before, token, _ = pitmanyor.word_pairs(pa.array([r["text"] or ""], pa.large_string()))
        for u, w in zip(before.tolist(), token.tolist()):
            want[u, w] += not r["held_out"]
    assert dict(got) == dict(want)


def test_lm_beats_word_shares_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", pitmanyor.held_out().alias("held_out"))
    by = {r["held_out"]: r for r in pitmanyor.perplexity(pitmanyor.score_corpus(docs, slices=2)).collect()}
    assert by[True]["perplexity"] < by[True]["base_perplexity"] and by[False]["perplexity"] < by[False]["base_perplexity"]
