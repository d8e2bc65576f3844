"""Packing, digests, n-gram join, neighbours, URL filter and the pipeline against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, digest, ngramjoin, packing, queries, urlfilter

SF = "/root/testdata/sf0.001"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def naive_packing(lengths, capacities, cost, least):
    """Best fit by scanning lists: [used, capacity] of each bin."""
    bins = []
    for k, size in enumerate(lengths):
        fitting = [b for b in bins if b[1] - b[0] >= max(size, 1)]
        if not size and bins:
            fitting = [bins[-1]]
        if not fitting:
            choices = []
            for c in (c for c in capacities if c >= size):
                held, waiting = size, list(lengths[k + 1 :])
                while takes := [x for x in waiting if 0 < x <= c - held]:
                    held += max(takes)
                    waiting.remove(max(takes))
                choices.append((cost(min(x for x in capacities if x >= held)) / max(held, 1), c))
            opened = [c for _, c in choices if c >= (least or 0)] or [choices[-1][1]]
            bins.append([0, opened[0] if least else min(choices)[1]])
            fitting = [bins[-1]]
        min(fitting, key=lambda b: b[1] - b[0])[0] += size
    return [b[0] for b in bins], [b[1] for b in bins]


def test_packer_equals_naive_best_fit():
    rng, capacities, cost = random.Random(1), (16, 32, 64), lambda c: c * (1 + c / 256)
    shrunk = 0
    for _ in range(150):
        lengths = sorted((rng.choice((rng.randint(0, 64), rng.randint(9, 12), 10)) for _ in range(rng.randint(1, 60))), reverse=True)
        costs = []
        for least in (None, *capacities):
            packer = packing.Packer(capacities, cost, least)
            packer.pack([-x for x in lengths])
            used, opened = naive_packing(lengths, capacities, cost, least)
            assert packer.used == used
            costs.append(sum(cost(min(c for c in capacities if c >= u)) for u in used))
            shrunk += sum(c < o for c, o in zip(packer.downsized(), opened))
        numbers, offsets, final = packing.packed([-x for x in lengths], capacities, cost)
        assert sum(map(cost, final)) == min(costs)
        filled = [0] * len(final)
        for number, offset, size in zip(numbers, offsets, lengths):
            assert offset == filled[number]
            filled[number] += size
        assert all(u <= c for u, c in zip(filled, final))
    assert shrunk > 100


def test_packing_chooses_between_lengths():
    total = lambda sizes: sum(packing.sequence_cost(c) for c in packing.packed(sorted(-s for s in sizes), packing.CAPACITIES)[2])
    assert total([600] * 5000) < 3_550_000  # three to 2048, where one to 1024 costs 5,200,000
    assert set(packing.packed([-1000] * 40, packing.CAPACITIES)[2]) == {1024}
    rng = random.Random(2)
    for _ in range(30):  # small shards against the best of all ways to share items among bins
        sizes = [rng.randint(1, 9000) for _ in range(6)]

        def least(k, loads):
            if k == len(sizes):
                return sum(packing.sequence_cost(min(c for c in packing.CAPACITIES if c >= u)) for u in loads)
            ways = [loads[:j] + [u + sizes[k]] + loads[j + 1 :] for j, u in enumerate(loads) if u + sizes[k] <= packing.CAPACITIES[-1]] + [[*loads, sizes[k]]]
            return min(least(k + 1, way) for way in ways)

        assert least(0, []) - 1e-6 <= total(sizes) <= 1.35 * least(0, [])


def test_packing_loses_nothing(spark):
    docs = read(spark, "documents").select("doc_id", "text").unionByName(frame(spark, [(-1, None), (-2, ""), (-3, "x" * 100_000), (None, "y"), (None, "y")])).withColumn("length", F.lit("clash"))
    got = packing.pack(docs, shard_items=50).toPandas()
    want = {r.doc_id: r.n for r in docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert len(got[got.doc_id.isna()]) == 2
    for _, rows in got.groupby("bin_id"):
        spans = sorted(zip(rows.bin_offset, rows.length))
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        filled = rows.length.sum()
        assert rows.capacity.nunique() == 1 and rows.capacity.iloc[0] == min(c for c in packing.CAPACITIES if c >= filled)
    for _, rows in got[got.doc_id.notna()].groupby("doc_id"):
        rows = rows.sort_values("piece")
        assert rows.start.tolist() == np.cumsum([0, *rows.length[:-1]]).tolist()
    assert packing.pack(docs.limit(0)).count() == 0


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op7_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op7_exact_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[list(want.columns)].astype(str).equals(want.astype(str))


def test_digest_index_persists(spark):
    index = digest.fresh_index(spark, 4)
    first = frame(spark, [(1, "a b"), (2, "ab "), (3, None), (4, ""), (5, "c"), (5, "c"), (None, "ab")]).withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(1))
    labelled = digest.label_copies(first, index).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in labelled if r.doc_id) == [(1, 1, 3), (2, 1, 3), (3, 3, 2), (4, 3, 2), (5, 5, 2), (5, 5, 2)]
    assert sum(r.kept for r in labelled) == 3
    again = digest.DigestIndex(spark, index.path, 4)  # as a later session finds it
    kept = digest.drop_copies(frame(spark, [(10, "ab"), (11, "new"), (12, "n e w")]).withColumn("n_code_points", F.lit(3)), again)
    assert sorted((r.doc_id, r.n_code_points) for r in kept.collect()) == [(12, 3)]
    assert again.read().count() == 4
    assert digest.label_copies(first.limit(0), digest.fresh_index(spark)).count() == 0


def test_digest_index_keeps_its_buckets(spark):
    rows = frame(spark, [(k, f"text {k}") for k in range(200)])
    path = digest.fresh_index(spark, 8).path
    assert digest.drop_copies(rows, digest.DigestIndex(spark, path)).count() == 200
    for buckets in (8, None):
        again = digest.DigestIndex(spark, path, buckets)
        assert again.buckets == 8 and again.read().count() == 200
        found = digest.representatives(digest.digest_rows(rows))
        assert again.new(found).count() == 0
        assert "SortMergeJoin" in again.new(found)._jdf.queryExecution().toString()
        assert digest.drop_copies(rows, again).count() == 0
    for buckets in (3, 4, 16):
        with pytest.raises(ValueError):
            digest.DigestIndex(spark, path, buckets)


def test_digest_rows_from_files_and_plans(spark, tmp_path):
    rows = [(1, "a b", None), (1, "a b", None), (2, "ab", 5), (3, None, 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest long").withColumn("row", F.lit("clash"))
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs")), docs.withColumn("_metadata", F.lit(1))):
        kept = digest.drop_copies(given, digest.fresh_index(spark, 4))
        assert kept.columns == given.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b"), (3, None)]


@pytest.mark.parametrize("fails_at", [1, 2, 3, 4, 5])
def test_a_batch_that_failed_is_offered_again(spark, monkeypatch, fails_at):
    """Whichever write fails, the batch under its id loses nothing, and meanwhile counts against nobody."""
    docs = frame(spark, [(k, f"text {k % 60}") for k in range(90)])
    index, writes = digest.fresh_index(spark, 4), []

    def failing(real):
        def write(*args, **kwargs):
            writes.append(1)
            if len(writes) == fails_at:
                raise RuntimeError("the driver is lost")
            return real(*args, **kwargs)

        return write

    with monkeypatch.context() as patched:
        writer = type(docs.write)
        for name in ("saveAsTable", "json"):
            patched.setattr(writer, name, failing(getattr(writer, name)))
        patched.setattr(digest, "written", failing(digest.written))
        with pytest.raises(RuntimeError):
            digest.drop_copies(docs, index, batch="monday").count()
    later = digest.DigestIndex(spark, index.path, 4)
    other = digest.drop_copies(frame(spark, [(200, "text 1"), (201, "text 2")]), later, batch="tuesday")
    assert sorted(r.doc_id for r in other.collect()) == [200, 201]
    assert sorted(r.doc_id for r in digest.drop_copies(docs, later, batch="monday").collect()) == [0, *range(3, 60)]
    assert sorted(r.doc_id for r in digest.drop_copies(docs, later, batch="monday").collect()) == [0, *range(3, 60)]  # again under its id
    assert digest.drop_copies(docs, later).count() == 0
    labels = digest.label_copies(frame(spark, [(1000, "text 1"), (1001, "text 7"), (1002, "new")]), later).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in labels) == [(1000, 200, False), (1001, 7, False), (1002, 1002, True)]


def test_a_compacted_index_knows_the_same(spark):
    index = digest.fresh_index(spark, 4)
    for k in range(3):
        digest.drop_copies(frame(spark, [(10 * k + j, f"text {10 * k + j}") for j in range(8)]), index, batch=f"b{k % 2}")
    copy = index.compacted(index.path + "-compact")
    assert copy.read().count() == index.known().count() == 16 and copy.read().inputFiles().__len__() <= 4
    again = digest.DigestIndex(spark, copy.path)
    assert digest.drop_copies(frame(spark, [(99, "text 11"), (98, "other")]), again).collect()[0].doc_id == 98


def test_rows_out_of_explode_are_told_apart(spark, tmp_path):
    frame(spark, [(k, f"text {k}") for k in range(40)]).write.parquet(str(tmp_path / "docs"))
    twice = spark.read.parquet(str(tmp_path / "docs")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert digest.drop_copies(twice, digest.fresh_index(spark, 4)).count() == 40
    joined = spark.read.parquet(str(tmp_path / "docs")).join(spark.range(2).withColumnRenamed("id", "copy"))
    assert digest.drop_copies(joined, digest.fresh_index(spark, 4)).count() == 40


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4:
                c = len(x & y)
                if 100 * c >= 80 * (len(x) + len(y) - c):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, n, size=60, edits=4):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block, column", [(1000, 100_000), (7, 100_000), (7, 5)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block, column):
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngramjoin, "COLUMN_ROWS", column)
    texts = family(1, 30) + family(2, 25, 40, 3) + family(3, 8, 9, 1) + ["one two", "One  two", "", None, "five words are right here", "five words are right HERE"] + family(1, 3)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    docs = frame(spark, rows).withColumn("column", F.lit("clash")).withColumn("rep", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_components(docs).collect()}
    assert got == brute_components(rows)


def test_ngram_join_on_documents_and_edges(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_components(read(spark, "documents")).collect()}
    assert got == brute_components(rows)
    assert ngramjoin.near_components(frame(spark, [])).count() == 0
    odd = frame(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "other words in here now"), (3, "other words in here now"), (4, "x " * 50_000)])
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.near_components(odd).collect()]
    assert (None, 2, None) in found and (3, 1, 2) in found and (4, 1, 4) in found
    kept = ngramjoin.keep_one(odd)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "4", "None"]


def test_overlap_product():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 60)).astype(np.uint64) for _ in range(12)]
    got = ngramjoin.overlaps(sets[:5], sets[5:], width=32)
    assert got.astype(int).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in ngramjoin.components(links).collect()}
    assert {got[k] for k in range(41)} == {0} and got[101] == 100


def test_neighbours_recall_and_edges(spark):
    vectors = read(spark, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 25 = 0")
    found = ann.search(vectors, asked, k=10, block_rows=150)
    assert ann.recall(found, vectors, asked) >= 0.9
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in vectors.collect()}
    for r in found.collect():
        assert r.score == pytest.approx(float(np.sqrt(((rows[r.vec_id] - rows[r.query_id]) ** 2).sum())), rel=1e-12) and r.vec_id != r.query_id
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 0.0]), (None, [1.0, 0.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in ann.search(odd, odd.where("vec_id = 0 or vec_id = 7"), k=10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 6, 1.0)]
    assert ann.search(odd.limit(0), odd.limit(0)).count() == 0


def test_collision_index_verifies_few_and_finds_most():
    rng = np.random.default_rng(2)
    for vectors in (rng.standard_normal((20_000, 48)), rng.standard_normal((200, 48))[rng.integers(0, 200, 20_000)] + 0.1 * rng.standard_normal((20_000, 48))):
        index = ann.CollisionIndex(np.arange(len(vectors)), vectors, 10)
        hits = 0
        for q in range(0, len(vectors), 500):
            d = ann.distances(vectors, vectors[q])
            d[q] = np.inf
            ids, found = index.search(q, vectors[q])
            assert np.array_equal(found, d[ids]) and len(ids) == 10
            hits += len(set(ids.tolist()) & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert hits / 400 >= 0.9 and index.verified / 40 / len(vectors) < 0.1


def test_neighbours_of_extreme_vectors(spark):
    rows = [(k, [s * x for x in v]) for k, (s, v) in enumerate([(1e200, (1, 0)), (1e200, (0, 1)), (1e200, (1, 1)), (1e-200, (1, 0)), (1e-200, (0, 1)), (1.0, (3, 4))])] + [(100, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(df, df, k=10).collect()}
    assert len(got) == 7 * 6
    for i, x in rows:
        for j, y in rows:
            if i != j:
                assert got[i, j] == pytest.approx(float(np.hypot(*(np.longdouble(a) - np.longdouble(b) for a, b in zip(x, y)))), rel=1e-9)


def test_url_rules_against_plain_python(spark):
    rules = urlfilter.RULES

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        path = re.split(r"[?#]", tail)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h, p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1]

    pages = read(spark, "pages").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "no scheme"), (-4, "HTTP://WWW.Example.COM/en/x?y#z"), (-5, "http://com"), (-6, "http://x.net/fr/"), (-7, "a://b://c/d"), (-8, "http://notexample.com/en/\n#")], "page_id long, url string")
    df = pages.unionByName(odd).withColumn("rule", F.lit(1))
    model = urlfilter.fit(urlfilter.seed_labels(read(spark, "pages", "/root/testdata/sf0.1")))
    got = urlfilter.judge(df, model).collect()
    assert len(got) == df.count()
    verdicts = {h + p: v for h, p, v in rules}
    for r in got:
        assert (r.host, r.path, r.rule) == plain(r.url)
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
    clashing = [c for c in (*urlfilter.FEATURES, "suffix", "last_word", "features", "probability", "prediction", "row_as_given") if c not in df.columns]
    odd_names = df.withColumns({c: F.lit(f"mine {c}") for c in clashing})
    same = {r.page_id: r for r in urlfilter.judge(odd_names, model).collect()}
    assert all(same[r.page_id].verdict == r.verdict and all(same[r.page_id][c] == f"mine {c}" for c in clashing) for r in got)
    assert urlfilter.judge(df.limit(0), model).count() == 0
    assert urlfilter.fit(urlfilter.seed_labels(pages.limit(0))).constant == 0.0


def test_url_filter_on_hosts_it_has_not_seen(spark):
    """Labels by word, and separately by shape alone: in both the hosts judged are others than those learned from."""
    pages = read(spark, "pages", "/root/testdata/sf0.1")
    labelled = urlfilter.seed_labels(pages)
    fold = F.pmod(F.xxhash64(urlfilter.host_of(F.col("url")), F.lit("test")), F.lit(4))
    model = urlfilter.fit(labelled.where(fold > 0))
    seen = urlfilter.judge(labelled.where(fold == 0).withColumnRenamed("label", "truth"), model, []).toPandas()
    assert len(seen) > 300 and ((seen.verdict == "block") == (seen.truth == 1)).mean() > 0.97
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    good = [f"https://www.{word(8)}.example/{word(6)}/{word(5)}" for _ in range(700)]
    bad = [f"http://{word(4)}-{word(5)}-{rng.randint(100, 999)}.example/{rng.randint(10**6, 10**8)}?a={word(3)}&b={word(3)}&c=1" for _ in range(700)]
    rows = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, label int")
    part = F.pmod(F.xxhash64("url"), F.lit(2))
    found = urlfilter.judge(rows.where(part == 0).withColumnRenamed("label", "truth"), urlfilter.fit(rows.where(part == 1)), []).toPandas()
    assert ((found.verdict == "block") == (found.truth == 1)).mean() > 0.97


def test_url_features_against_plain_python(spark):
    from math import log2

    urls = ["https://a-b.c1.example.com/x/y2/z?q=1&r=2#t", "http://aabb.nl", "no host", "", None, "x://h/" + "p" * 5000, "a://UPPER.Example/A1"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in urlfilter.with_features(urlfilter.with_parts(rows)).collect():
        url, host, path = r.url or "", r.host, r.path
        entropy = lambda t: -sum(t.count(c) / len(t) * log2(t.count(c) / len(t)) for c in set(t)) if t else 0
        query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
        want = {"url_length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "digit_ratio": sum(c.isdigit() for c in url) / max(len(url), 1), "host_digits": sum(c.isdigit() for c in host), "host_entropy": entropy(host),
                "path_entropy": entropy(path), "parameters": query.count("&") + 1 if query else 0, "host_hyphens": host.count("-"), "host_labels": len(host.split(".")), "longest_label": max(map(len, host.split(".")))}
        assert {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} == {k: r[k] for k in want}, url[:40]
        assert r.suffix == host.split(".")[-1]


def test_stages_on_empty_and_clashing_tables(spark):
    docs = read(spark, "documents").limit(60).withColumns({c: F.lit(f"mine {c}") for c in ("lang_pred", "toxic", "digest", "component_id", "score", "signature", "_digest")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() > 0 and after.where("toxic <> 'mine toxic' or _digest <> 'mine _digest'").isEmpty(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages(spark):
    docs = read(spark, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "ngram_jaccard", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows, kept = docs.collect(), after.collect()
        assert set(r.doc_id for r in kept) <= set(r.doc_id for r in rows)
        if name == "exact_dedup":
            squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert len(kept) == len({squeeze(r.text) for r in rows}) == len({squeeze(r.text) for r in kept})
        if name == "ngram_jaccard":
            brute = brute_components([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id for r in kept} == {i for i, (_, c) in brute.items() if c == i}
        if name == "language_id":
            assert len(kept) > 0.95 * len(rows)
        docs = after
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()


def test_html_keeps_what_stands_beside_the_largest_part():
    from tidemark.llm import htmlextract

    lead, body = "The lead says what this is about. " * 3, "The long body of the article goes on. " * 20
    inner = f"<p>{lead}</p><div class='body'><p>{body}</p></div>"
    for page in (f"<body><nav>Menu words here</nav><article><h1>Title</h1>{inner}</article></body>", f"<body><nav>Menu words here</nav><div id='x'><h1>Title</h1>{inner}</div></body>"):
        text, _ = htmlextract.text_of(htmlextract.parse(page), None)
        assert text.split("\n\n") == ["Title", lead.strip(), body.strip()]
    other = htmlextract.parse(f"<body><article class='teaser'><p>Short words only.</p></article><main><p>{body}</p></main></body>")
    teaser = next(other.path(n) for n in range(1, len(other.label)) if other.tag[n] == "article")
    assert htmlextract.text_of(other, [teaser])[0].endswith(body.strip())


def test_html_furniture_by_whole_names():
    from tidemark.llm import htmlextract

    body, extra = "The long body of the article goes on. " * 20, "More of it stands here, a part of the text. " * 3
    article = lambda inner, attributes="": f"<body><div class='main-nav'>Menu words here</div><article{attributes}><h1>Title</h1>{inner}</article><div id='site-footer'>About us</div></body>"
    want = ["Title", body.strip(), extra.strip()]
    cases = [
        (article(f"<p>{body}</p><div class='side-effects'><p>{extra}</p></div>"), want),
        (f"<body><div class='sidebar-left'>Links and more</div><div class='post tags-python'><h1>Title</h1><p>{body}</p><p>{extra}</p></div></body>", want),
        (article(f"<header><p>{body}</p></header><p>{extra}</p>"), want),
        (f"<body><header><h1>Title</h1><p>The slogan of the site</p></header><div class='notice'><p>{body}</p><p>{extra}</p></div></body>", want),
        (f"<body><form><div id='page'><h1>Title</h1><p>{body}</p><p>{extra}</p></div><input></form></body>", want),
        (f"<body><form><article><h1>Title</h1><p>{body}</p><p>{extra}</p></article></form><div class='ad-300x250'>Buy now</div></body>", want),
        (article(f"<p>{body}</p><p>{extra}</p>", " class='comments-open ad'") + f"<div class='comments-area'><p>{'A reader says a lot. ' * 200}</p></div>", want),
        (article(f"<p>{body}</p><div class='newsletter-signup'>{'Sign up here for more. ' * 100}</div><p>{extra}</p><section id='comments'><p>{'So true. ' * 500}</p></section>"), want),
    ]
    for page, blocks in cases:
        text, _ = htmlextract.text_of(htmlextract.parse(page), None)
        assert text.split("\n\n") == blocks, page[:200]
