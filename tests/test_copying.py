"""Tables copied under new ids."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import copying


def test_every_reference_means_the_same_row(spark, tmp_path):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 500)
    posts = [(i, rng.choice([None, *ids[:50], 20_000]) if k else ids[1], rng.choice([5, 9, 77, None]), f"t{i}", k) for k, i in enumerate(ids)]
    posts += [(None, ids[0], 5, "no id", 1), (ids[3], ids[4], 9, "repeat", 2)]
    tables = {
        "postings": spark.createDataFrame(posts, "id long, duplicate_of long, source_id long, title string, new long").repartition(7),
        "sources": spark.createDataFrame([(9, "b"), (5, "a"), (77, "c")], "id long, old string"),
        "notes": spark.createDataFrame([("x", ids[7]), ("y", None)], "note string, posting long"),
    }
    keys, refs = {"postings": "id", "sources": "id"}, [("postings", "duplicate_of", "postings"), ("postings", "source_id", "sources"), ("notes", "posting", "postings")]
    want = {i: n for n, i in enumerate(sorted(ids), 1)}
    boards = {5: 1, 9: 2, 77: 3}
    counts = copying.copy_tables(tables, keys, refs, str(tmp_path))
    assert counts == {"postings": 502, "sources": 3, "notes": 2}
    copied = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    assert copied["postings"].columns == tables["postings"].columns
    got = sorted((tuple(r) for r in copied["postings"].collect()), key=str)
    assert got == sorted(((want.get(i), want.get(d), boards.get(s), t, n) for i, d, s, t, n in posts), key=str)
    assert sorted(tuple(r) for r in copied["sources"].collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert {tuple(r) for r in copied["notes"].collect()} == {("x", want[ids[7]]), ("y", None)}
    lost = {(r["table"], r["column"]): r["rows"] for r in copying.unresolved(tables, keys, refs).collect()}
    assert lost["postings", "duplicate_of"] == sum(p[1] == 20_000 for p in posts) and lost["postings", "source_id"] == 0
    assert all(r["rows"] == 0 for r in copying.unresolved(copied, keys, refs).collect())
    with pytest.raises(Exception, match="exist"):
        copying.copy_tables(tables, keys, refs, str(tmp_path))
    assert copying.dense_ids(tables["postings"].limit(0)).count() == 0


def test_null_references_are_spread_over_tasks(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.col("id") + 1).cast("int").alias("up"), F.col("id").cast("string").alias("name"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = copying.renumbered({"t": rows}, {"t": "id"}, [("t", "up", "t")])["t"]
        tasks = {r["p"]: r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(tasks) > 1 and max(tasks.values()) < 2000
    assert {(r.id, r.up, r.name) for r in out.collect()} == {(k + 1, k + 2 if k % 100 == 0 else None, str(k)) for k in range(4000)}
