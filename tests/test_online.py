from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators.vocab import decayed_weights
from callweave.streaming import online
from tests.test_vectors import planted


def points(spark, seed=0):
    x = planted(seed)
    order = np.random.default_rng(seed).permutation(len(x))
    rows = [(n, f"2020Q{n // 15 + 1}", [float(v) for v in x[i]]) for n, i in enumerate(order)]
    return spark.createDataFrame(rows, "doc_id long, yearq string, embedding array<double>")


def basis(x, k):
    """Mean and leading axes; each axis points where its largest entry is positive."""
    values, vectors = np.linalg.eigh(np.cov(x.T))
    axes = vectors[:, np.argsort(values)[::-1][:k]].T
    return x.mean(0), axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]


def brute(rows, start, alpha, dims=None):
    centres, n, seen, old = np.array(start), np.zeros(len(start)), np.zeros((0, len(start[0]))), None
    topics = {}
    for q in sorted({r.yearq for r in rows}):
        batch = [r for r in sorted(rows, key=lambda r: r.doc_id) if r.yearq == q]
        x = np.array([r.embedding for r in batch])
        if dims:
            seen = np.vstack([seen, x])
            mean, axes = basis(seen, dims)
            centres = ((centres @ old[1] + old[0] if old else centres) - mean) @ axes.T
            x, old = (x - mean) @ axes.T, (mean, axes)
        near = [int(np.argmin(np.linalg.norm(centres - v, axis=1))) for v in x]
        for j in range(len(centres)):
            mine = [v for v, t in zip(x, near) if t == j]
            total = alpha * n[j] + len(mine)
            if mine:
                centres[j] = (alpha * n[j] * centres[j] + np.sum(mine, 0)) / total
            n[j] = total
        topics.update({r.doc_id: int(np.argmin(np.linalg.norm(centres - v, axis=1))) for r, v in zip(batch, x)})
    return topics


@pytest.mark.parametrize("dims", [None, 2])
def test_batch_and_stream_agree_with_a_plain_loop(spark, tmp_path, dims):
    """With and without a reduction, whose basis turns from period to period."""
    df = points(spark)
    rows = df.collect()
    start = np.array([r.embedding for r in sorted(rows, key=lambda r: r.doc_id)[:4]])
    want = brute(rows, start, 0.5, dims)
    batch = {r.doc_id: r.topic for r in online.online_fit(df, "yearq", 4, alpha=0.5, n_components=dims, start=start).collect()}
    assert batch == want
    root = str(tmp_path)
    slim = df.select("doc_id", "embedding", "yearq")
    online.publish_periods(slim, "yearq", root)
    stream = online.online_fit_stream(spark, root, "yearq", slim.schema, 4, alpha=0.5, n_components=dims, start=start)
    assert {r.doc_id: r.topic for r in stream.collect()} == want


@pytest.mark.parametrize("dims", [None, 3])
def test_start_comes_from_all_rows_of_the_first_period(spark, dims):
    """Three planted groups are told apart although the first rows by id all lie in one of them."""
    x = planted(seed=6, groups=3, size=30)
    rows = [(i, f"2020Q{1 + (i % 30) // 15}", [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, yearq string, embedding array<double>")
    got = {r.doc_id: r.topic for r in online.online_fit(df, "yearq", 3, n_components=dims).collect()}
    groups = [{got[i] for i in range(g * 30, g * 30 + 30)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_missing_centres_come_with_later_periods(spark):
    """A first period with one vector gives one centre; the others are drawn far from it later. Rows without a period are left out."""
    rows = [(0, "a", [0.0, 0.0]), (1, "a", [0.0, 0.0])] + [(i, "b", [10.0 * (i % 3), 5.0 * (i % 2)]) for i in range(2, 40)] + [(99, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id long, yearq string, embedding array<double>")
    got = {r.doc_id: r.topic for r in online.online_fit(df, "yearq", 4).collect()}
    assert set(got) == set(range(40)) and got[0] == got[1] == 0 and len(set(got.values())) == 4
    assert online.online_fit(df.limit(0), "yearq", 4).count() == 0


def weights_by_hand(rows, topics, periods, decay, least):
    held = {}
    for p in periods:
        held = {k: w * (1 - decay) for k, w in held.items()}
        for i, period, text in rows:
            if period == p:
                for word in text.split():
                    held[topics[i], word] = held.get((topics[i], word), 0) + 1
        held = {k: w for k, w in held.items() if w >= least}
    return held


@pytest.mark.parametrize("least", [0.0, 1.5])
def test_weights_follow_the_topics_of_the_same_step(spark, tmp_path, least):
    df = points(spark)
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(rng.choice(["cats", "dogs", "birds", "fish", "newts"], size=rng.integers(0, 5)))) for i in range(60)]
    full = df.join(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id").select("doc_id", "embedding", "text", "yearq")
    rows = full.collect()
    start = np.array([r.embedding for r in sorted(rows, key=lambda r: r.doc_id)[:3]])
    root = str(tmp_path)
    online.publish_periods(full, "yearq", root)
    topics, weights = online.online_topics_stream(spark, root, "yearq", full.schema, 3, n_components=2, start=start, decay=0.3, least=least)
    got = {r.doc_id: r.topic for r in topics.collect()}
    assert got == brute(rows, start, 1.0, 2)
    want = weights_by_hand([(r.doc_id, r.yearq, r.text) for r in rows], got, sorted({r.yearq for r in rows}), 0.3, least)
    held = {(r.topic, r.term): r.weight for r in weights.collect()}
    assert held.keys() == want.keys() and all(abs(held[k] - want[k]) < 1e-9 for k in want)
    # The last step again, as after a failure: the same topics and weights.
    last = full.where("yearq = '2020Q4'")
    assigned = online.fit_batch(last, 3, root, 3, n_components=2, start=start)
    online.decay_batch(assigned, 3, root, 0.3, least=least)
    assert {(r.topic, r.term): r.weight for r in online.last_weights(spark, root).collect()} == held
    assert {r.doc_id: r.topic for r in spark.read.parquet(f"{root}/topics").collect()} == got


def test_steps_follow_the_numbers_of_the_periods(spark, tmp_path):
    """The order of the announcements counts, not the times of their files; a missing one stops the run."""
    import os

    df = points(spark).select("doc_id", "embedding", "yearq")
    root = str(tmp_path)
    online.publish_periods(df, "yearq", root)
    files = sorted(f for f in os.listdir(f"{root}/periods") if f.endswith(".parquet"))
    for at, name in enumerate(sorted(files, key=lambda f: os.path.getmtime(f"{root}/periods/{f}"), reverse=True)):
        os.utime(f"{root}/periods/{name}", (1_000_000 + at, 1_000_000 + at))
    seen = []
    online.run_stream(spark, root, "yearq", df.schema, lambda rows, i: seen.append((i, rows.first().yearq)), "order")
    assert seen == [(i, f"2020Q{i + 1}") for i in range(4)]


def test_replayed_batch_gives_the_same_state(spark, tmp_path):
    df = points(spark)
    root = str(tmp_path)
    quarters = [df.where(F.col("yearq") == f"2020Q{q}").drop("yearq") for q in (1, 2)]
    for i, q in enumerate(quarters):
        online.fit_batch(q, i, root, 3)

    def state():
        return sorted((r.topic, r.n, tuple(r.centre)) for r in spark.read.parquet(f"{root}/centres/batch=1").collect())

    before = state()
    online.fit_batch(quarters[1], 1, root, 3)
    assert state() == before


def test_decayed_weights(spark, tmp_path):
    rows = [(0, 2010, 0, "cats dogs cats"), (1, 2011, 0, "cats"), (2, 2012, 1, "dogs birds"), (3, 2012, 0, "birds")]
    df = spark.createDataFrame(rows, "doc_id long, year int, topic int, text string")
    want = {(0, "cats"): 2 * 0.9**2 + 0.9, (0, "dogs"): 0.9**2, (0, "birds"): 1.0, (1, "dogs"): 1.0, (1, "birds"): 1.0}
    batch = {(r.topic, r.term): r.weight for r in decayed_weights(df, "year", decay=0.1).collect()}
    slim = df.select("doc_id", "topic", "text", "year")
    online.publish_periods(slim, "year", str(tmp_path))
    stream = online.decayed_weights_stream(spark, str(tmp_path), "year", slim.schema, decay=0.1)
    for got in (batch, {(r.topic, r.term): r.weight for r in stream.collect()}):
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_periods_add_their_first_vectors_until_there_are_enough(spark):
    rows = [(3, "a", [0.0, 0.0]), (7, "a", [10.0, 0.0]), (1, "b", [0.0, 10.0]), (2, "b", [10.0, 10.0]), (4, "b", [0.0, 10.2]), (5, "c", [10.0, 9.0])]
    df = spark.createDataFrame(rows, "doc_id long, p string, embedding array<double>")
    got = {r.doc_id: r.topic for r in online.online_fit(df, "p", 3, grow="least").collect()}
    assert got == {3: 0, 7: 1, 1: 2, 4: 2, 2: 1, 5: 1} or got == {3: 0, 7: 1, 1: 2, 4: 2, 2: 2, 5: 1}


def test_a_step_stores_no_more_than_its_own_counts(spark, tmp_path):
    """Step by step with other decays, a step without terms among them, the weights are those of a plain loop."""
    root = str(tmp_path)
    steps = [("cats dogs", 0.1), ("cats", 0.2), ("", 0.5), ("birds cats cats", 0.25)]
    held = {}
    for i, (text, decay) in enumerate(steps):
        online.decay_batch(spark.createDataFrame([(0, text)], "topic int, text string"), i, root, decay)
        held = {k: w * (1 - decay) for k, w in held.items()}
        for word in text.split():
            held[word] = held.get(word, 0) + 1
        got = {r.term: r.weight for r in online.last_weights(spark, root).collect()}
        assert got.keys() == held.keys() and all(abs(got[k] - held[k]) < 1e-12 for k in held)
    assert spark.read.parquet(f"{root}/counts").where("batch = 3").count() == 2
    with pytest.raises(FileNotFoundError):
        online.decay_batch(spark.createDataFrame([(0, "x")], "topic int, text string"), 7, root)


def test_a_stored_period_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from callweave.sources import transcripts as tr

    monkeypatch.setattr(tr, "ROW_GROUP_BYTES", 1 << 16)
    df = spark.range(20_000).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text", "2020 as year").coalesce(1)
    tr.ingest(df, str(tmp_path / "rows"), "year")
    import pyarrow.parquet as pq

    files = list((tmp_path / "rows" / "year=2020").glob("*.parquet"))
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > 4 * len(files)
