"""Crawls as a stream against the batch merge, however the stream is cut."""

import datetime as dt
import random

import pytest
from test_operators import POSTING, empty_state, posting

from tidemark.operators import ingest
from tidemark.streaming import crawls

ROWS = "run timestamp_ntz, listed int, " + POSTING
RUNS = [dt.datetime(2026, 9, 1 + k, 12) for k in range(3)]


def crawled(rng):
    """Two boards' postings in three runs: some vanish, some change, one comes under a new id."""
    out = []
    for k, run in enumerate(RUNS):
        for source in (1, 2):
            rows = [posting(n, source, text=f"Version {rng.choice([1, 1, 2])} of a text about the work that has to be done here.", url=f"https://x/{source}/{n}") for n in range(12) if rng.random() < 0.8]
            rows.append(posting(f"moved-{k}", source, url=f"https://x/{source}/same"))
            out += [(run, len(rows), *r) for r in rows]
    return out


def streamed(spark, rows, cuts, folder):
    bounds = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a < b:
            spark.createDataFrame(rows[a:b], ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    sources = spark.createDataFrame([(1, 12), (2, 12)], "source_id long, last_nl_count int")
    stream = crawls.read_rows(spark, f"{folder}/in", spark.createDataFrame([], ROWS).schema, files_per_batch=1)
    crawls.write_crawls(stream, sources, f"{folder}/out", f"{folder}/check").awaitTermination()
    state = empty_state(spark).select("source_id", "external_id", "first_seen", "last_seen", "closed_at", *ingest.CONTENT).schema
    return {tuple(r) for r in crawls.stored_state(spark, f"{folder}/out", state).collect()}


def batch_merged(spark, rows, runs=RUNS):
    sources = spark.createDataFrame([(1, 12), (2, 12)], "source_id long, last_nl_count int")
    state = empty_state(spark).select("source_id", "external_id", "first_seen", "last_seen", "closed_at", *ingest.CONTENT)
    for run in runs:
        snapshot = spark.createDataFrame([r[2:] for r in rows if r[0] == run and r[3] is not None], POSTING)
        state = spark.createDataFrame(ingest.merge(state, snapshot, sources, str(run)).drop("change").collect(), state.schema)
    return {tuple(r) for r in state.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_what_the_batch_merge_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = crawled(rng)
    near = sorted(range(len(rows)), key=lambda k: k + rng.randrange(15))  # rows of neighbouring runs mixed
    mixed = [rows[k] for k in near]
    assert streamed(spark, mixed, sorted(rng.sample(range(1, len(rows)), 4)), tmp_path) == batch_merged(spark, rows)


def test_incomplete_and_late_crawls(spark):
    at = lambda day: dt.datetime(2026, 9, day)
    rows = [(at(1), 2, 1, "a"), (at(2), 1, 1, "a"), (at(1), 1, 2, "b"), (at(1), 0, 3, None), (at(1), 1, 4, "x"), (at(3), 1, 4, "x"), (at(2), 2, 5, "x")]
    arrived = spark.createDataFrame(rows, "run timestamp_ntz, listed int, source_id long, external_id string")
    settled = spark.createDataFrame([(4, at(2), "merge")], "source_id long, run timestamp_ntz, verdict string")
    verdicts = lambda lateness: {(r.source_id, r.run.day): r.verdict for r in crawls.ready_crawls(arrived, settled, lateness).collect()}
    assert verdicts("2 days") == {(1, 1): "wait", (1, 2): "wait", (2, 1): "merge", (3, 1): "merge", (4, 1): "passed", (4, 3): "merge", (5, 2): "wait"}
    assert verdicts("1 day") == {(1, 1): "passed", (1, 2): "merge", (2, 1): "merge", (3, 1): "merge", (4, 1): "passed", (4, 3): "merge", (5, 2): "wait"}
