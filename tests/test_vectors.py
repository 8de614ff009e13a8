from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators import cluster as cl
from callweave.operators import density as de
from callweave.operators import descent as ds
from callweave.operators import encode as en
from callweave.operators import neighbours as nb
from callweave.operators import reduce as rd


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "doc_id long, embedding array<double>")


def planted(seed=0, groups=3, size=20, dims=6, gap=20.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * gap
    return np.vstack([c + rng.normal(size=(size, dims)) for c in centres])


def crowded(seed=1, n=240, dims=5):
    """A third of the rows are copies of one vector, some more lie in tight groups."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 6, size=(n, 1)) * 8
    x[: n // 3] = x[0]
    x[n // 3 : n // 3 + 10] = x[n // 3]
    return x[rng.permutation(n)]


def brute_knn(x, k, metric):
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.where(length > 0, x / np.where(length > 0, length, 1), 0)
        d = 1 - u @ u.T
        zero = (length == 0).ravel()
        d[np.ix_(zero, zero)] = 0.0
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((round(float(d[i, j]), 9) + 0.0, j) for j in range(len(x)) if j != i)[:k]
        out[i] = order
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("block_rows", [15, 60, 4096])
def test_knn_is_exact(spark, metric, block_rows):
    x = crowded()
    if metric == "cosine":
        x[5] = 0.0
        x[9] = 0.0
    got = {}
    for r in nb.knn_graph(frame(spark, x), 4, metric, block_rows=block_rows).collect():
        got.setdefault(r.id, []).append((r.rank, r.distance, r.neighbour))
    want = brute_knn(x, 4, metric)
    assert got.keys() == want.keys()
    for i, rows in got.items():
        rows = sorted(rows)
        assert [n for _, _, n in rows] == [j for _, j in want[i]], i
        assert all(abs(d - w) < 1e-8 for (_, d, _), (w, _) in zip(rows, want[i]))


def test_far_partitions_are_not_visited(spark):
    """With well separated groups a point visits few partitions."""
    x = planted(groups=8, size=40, gap=200.0)
    points = nb.metric_points(frame(spark, x), "euclidean", "doc_id", "embedding")
    pivots, placed, radius, count = nb._partitioned(points, 40)
    bounded = points.withColumn("bound", F.lit(8.0))
    assert nb._route(bounded, pivots, radius, count, 5).count() < len(x) * len(pivots) / 2


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_streamed_neighbours_are_those_of_the_partitions(spark, metric, monkeypatch):
    df = frame(spark, crowded())
    found = []
    for share in (2.0, -1.0):
        monkeypatch.setattr(nb, "STREAM_SHARE", share)
        found.append([(r.id, r.rank, r.neighbour, round(r.distance, 8)) for r in nb.knn_graph(df, 6, metric, block_rows=16).orderBy("id", "rank").collect()])
    assert found[0] == found[1] and len(found[0]) == 240 * 6


def test_visits_are_counted_without_copies(spark):
    x = np.random.default_rng(6).normal(size=(400, 3))
    queries = frame(spark, x).selectExpr("doc_id AS id", "embedding AS v", "CAST(1000 AS DOUBLE) AS bound")
    args = queries, x[:20], np.full(20, 100.0), np.full(20, 20.0), 100_000
    counted = nb._route(*args, counted=True)
    assert counted.columns == ["visits"] and counted.agg(F.sum("visits")).first()[0] == nb._route(*args).count() == 400 * 20


def test_pairwise_copies_rows_for_large_blocks_only(spark, monkeypatch):
    seen, owned = [], nb.owned_blocks

    def watched(points, start, step, finish, schema, key, blocks, *args):
        seen.append(sum(blocks.values()))
        return owned(points, start, step, finish, schema, key, blocks, *args)

    monkeypatch.setattr(nb, "owned_blocks", watched)
    got = nb.pairwise_distance(frame(spark, crowded(n=300)), block_rows=10).agg(F.min("others"), F.max("others"), F.count("id")).first()
    assert tuple(got) == (299, 299, 300) and seen == [4]


def test_few_points(spark):
    got = nb.knn_graph(frame(spark, np.eye(3)), 10).collect()
    assert len(got) == 6 and all(abs(r.distance - 1.0) < 1e-9 for r in got)


@pytest.mark.parametrize("block_rows", [30, 4096])
def test_pairwise(spark, block_rows):
    x = crowded(n=90)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in nb.pairwise_distance(frame(spark, x), block_rows=block_rows).collect():
        others = np.delete(d[r.id], r.id)
        assert r.others == len(x) - 1
        assert np.allclose([r.total, r.low, r.high], [others.sum(), others.min(), others.max()], atol=1e-6)


def brute_density(x, k, size, radius):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    core = np.array([np.sort(np.delete(d[i], i))[k - 1] for i in range(len(x))])
    dense = np.flatnonzero(core <= radius)
    label, groups = {}, []
    for i in dense:
        if i in label:
            continue
        todo, members = [i], {i}
        while todo:
            a = todo.pop()
            for b in dense:
                if b not in members and d[a, b] <= radius:
                    members.add(b)
                    todo.append(b)
        groups.append(sorted(members))
        label.update({m: 1 for m in members})
    topics = np.full(len(x), -1)
    for number, members in enumerate(sorted(g for g in groups if len(g) >= size)):
        topics[members] = number
    return topics


@pytest.mark.parametrize("block_rows", [25, 4096])
@pytest.mark.parametrize("radius", [0.8, 1.6, 2.4])
def test_density_matches_brute_force(spark, block_rows, radius):
    x = crowded(seed=4, n=150, dims=3)
    got = {r.doc_id: r.topic for r in de.density_topics(frame(spark, x), 3, 5, radius=radius, block_rows=block_rows).collect()}
    assert [got[i] for i in range(len(x))] == brute_density(x, 3, 5, radius).tolist()


def test_density_finds_groups_and_outliers(spark):
    x = np.vstack([planted(), [[500.0] * 6]])
    topics = {r.doc_id: r.topic for r in de.density_topics(frame(spark, x), 5, 10, quantile=0.95).collect()}
    assert topics[60] == -1
    found = [{topics[i] for i in range(a, a + 20)} - {-1} for a in (0, 20, 40)]
    assert [len(f) for f in found] == [1, 1, 1] and len(set.union(*found)) == 3


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(chain + star, "id long, root long")
    got = {r.id: r.root for r in de.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}
    assert de.connected_components(edges.limit(0)).count() == 0


def test_scrub(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("inf"), float("-inf"), None],)], "v array<double>")
    assert df.select(vx.scrub(F.col("v"))).first()[0] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_lloyd_cost_never_rises_and_models_are_independent(spark):
    x = planted(seed=3)
    df = frame(spark, x)
    costs = [cl.fit_many(df, [cl.Spec(3), cl.Spec(7)], max_iter=i, tol=0.0)[1] for i in range(4)]
    for m in range(2):
        assert all(a >= b - 1e-9 for a, b in zip([c[m] for c in costs], [c[m] for c in costs][1:]))
    alone = cl.fit_many(df, [cl.Spec(7)], max_iter=3, tol=0.0)
    assert abs(alone[1][0] - costs[3][1]) < 1e-9


def test_holdout_equals_fit_without_the_fold(spark):
    x = planted(seed=5)
    df = frame(spark, x).withColumn("fold", (F.col("doc_id") % 4).cast("int"))
    both, _ = cl.fit_many(df, [cl.Spec(3, holdout=1), cl.Spec(3)], fold="fold", max_iter=3, tol=0.0)
    alone, _ = cl.fit_many(df.where("fold <> 1"), [cl.Spec(3)], max_iter=3, tol=0.0)
    assert np.allclose(both[0], alone[0])


def test_start_ignores_copies(spark):
    x = np.vstack([np.ones((50, 2)), [[2.0, 2.0]], [[3.0, 3.0]]])
    (start,) = cl.initial_centres(frame(spark, x), [cl.Spec(3)], "embedding", None)
    assert sorted(start[:, 0]) == [1.0, 2.0, 3.0]


def test_model_bound(spark, monkeypatch):
    monkeypatch.setattr(cl, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        cl.collect_centres(spark.createDataFrame([(0, [1.0, 2.0])], "topic int, centre array<double>"))


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    fitted = rd.fit_projection(rd.moments(frame(spark, x)), 3)
    assert np.allclose(fitted.axes @ fitted.axes.T, np.eye(3), atol=1e-9)
    assert list(fitted.variances) == sorted(fitted.variances, reverse=True)
    assert np.allclose(fitted.variances, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3])
    halves = [rd.moments(frame(spark, part)) for part in (x[:70], x[70:])]
    merged = rd.fit_projection(rd.merge_moments(*halves), 3)
    assert np.allclose(merged.axes, fitted.axes)
    reduced = np.array([r.reduced for r in rd.pca_reduce(frame(spark, x), 3).orderBy("doc_id").collect()])
    assert np.allclose(reduced.mean(0), 0, atol=1e-9) and np.allclose(reduced.var(0, ddof=1), fitted.variances)


def test_projection_without_a_fold(spark):
    """The total moments less a fold's own give the projection fitted on the other rows alone."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4)) * [4, 2, 1, 0.5] + np.arange(90)[:, None] % 3
    df = frame(spark, x).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    lens = rd.holdout_projections(df, "fold", 2)
    assert sorted(lens) == [0, 1, 2]
    for f, got in lens.items():
        want = rd.fit_projection(rd.moments(df.where(F.col("fold") != f)), 2)
        assert np.allclose(got.mean, want.mean) and np.allclose(got.axes, want.axes) and np.allclose(got.variances, want.variances)
    rows = rng.normal(size=(5, 2))
    assert np.allclose(lens[0].apply(lens[0].restore(rows)), rows)
    with pytest.raises(ValueError):
        rd.fit_projection(rd.moments(df.limit(0)), 2)


def test_models_under_projections_equal_models_of_reduced_rows(spark):
    x = planted(seed=5)
    df = frame(spark, x).withColumn("fold", (F.col("doc_id") % 4).cast("int"))
    lens = rd.holdout_projections(df, "fold", 2)
    specs = [cl.Spec(3, holdout=f) for f in range(4)]
    start = [lens[f].apply(x[[0, 20, 40]]) for f in range(4)]
    got, _ = cl.fit_many(df, specs, fold="fold", max_iter=3, tol=0.0, init=start, lens=lens)
    labels = {r.doc_id: r.labels for r in cl.label_many(df, got, specs=specs, lens=lens).collect()}
    for f in range(4):
        reduced = frame(spark, lens[f].apply(x)).withColumn("fold", (F.col("doc_id") % 4).cast("int"))
        (alone,), _ = cl.fit_many(reduced.where(F.col("fold") != f), [cl.Spec(3)], max_iter=3, tol=0.0, init=[start[f]])
        assert np.allclose(got[f], alone)
        assert [labels[i][f] for i in range(60)] == [r.labels[0] for r in cl.label_many(reduced, [alone]).orderBy("doc_id").collect()]
    drawn = cl.initial_centres(df, specs, "embedding", "fold", lens=lens)
    assert all(c.shape == (3, 2) for c in drawn)


def test_more_models_than_fit_together_take_more_passes(spark, monkeypatch):
    df = frame(spark, planted(seed=3))
    specs = [cl.Spec(3), cl.Spec(5), cl.Spec(4)]
    start = cl.initial_centres(df, specs, "embedding", None)
    want = cl.fit_many(df, specs, max_iter=3, tol=0.0, init=start)
    labels = cl.label_many(df, want[0]).orderBy("doc_id").collect()
    monkeypatch.setattr(cl, "MODEL_BYTES", 8 * 6 * 8)
    assert cl._passes(start) == [range(0, 2), range(2, 3)]
    got = cl.fit_many(df, specs, max_iter=3, tol=0.0, init=start)
    assert all(np.allclose(a, b) for a, b in zip(got[0], want[0])) and np.allclose(got[1], want[1])
    assert cl.label_many(df, got[0]).orderBy("doc_id").collect() == labels


def test_small_steps_come_close_to_whole_passes(spark):
    """Repeatable, and an inertia of at most 1.1 times that of whole passes from the same start, for groups that touch each other."""
    x = planted(seed=7, groups=6, size=80, gap=3.0)
    df, specs = frame(spark, x), [cl.Spec(6), cl.Spec(3)]
    start = cl.initial_centres(df, specs, "embedding", None)
    centres, cost = cl.fit_minibatch(df, specs, batches=8, init=start)
    again, same = cl.fit_minibatch(df.repartition(3), specs, batches=8, init=start)
    assert all(np.allclose(a, b) for a, b in zip(centres, again)) and np.allclose(cost, same)
    whole = cl.fit_many(df, specs, init=start)[1]
    assert all(a <= 1.1 * b for a, b in zip(cost, whole))
    gaps = ((x[:, None] - centres[0][None]) ** 2).sum(2).min(1)
    assert np.isclose(gaps.sum(), cost[0])


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_descent_finds_nearly_all_neighbours(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24)) + 3 * rng.normal(size=(12, 24))[rng.integers(0, 12, 600)]
    x[:200] = x[0]  # a third are copies
    df = frame(spark, x)
    exact = nb.knn_graph(df, 8, metric)
    got = ds.neighbour_descent(df, 8, metric)
    assert ds.recall(got, exact) >= 0.95
    rows = got.collect()
    assert {r.rank for r in rows} == set(range(1, 9)) and len(rows) == 600 * 8 and all(r.id != r.neighbour for r in rows)
    near = {(i, j): d for i, edges in brute_knn(x, 599, metric).items() for d, j in edges}
    assert all(abs(near[r.id, r.neighbour] - r.distance) < 1e-8 for r in rows)
    assert ds.neighbour_descent(df.repartition(7), 8, metric).orderBy("id", "rank").collect() == got.orderBy("id", "rank").collect()


def test_descent_on_few_points(spark):
    assert ds.neighbour_descent(frame(spark, np.eye(3)), 5).count() == 6
    assert ds.neighbour_descent(frame(spark, np.eye(3)).limit(0), 5).count() == 0
    assert ds.neighbour_descent(frame(spark, np.eye(3)[:1]), 5).count() == 0


def test_descent_holds_many_centres_a_task(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(5).normal(size=(200, 6)))
    several = ds.neighbour_descent(df, 5).orderBy("id", "rank").collect()
    monkeypatch.setattr(ds, "CENTRES", 1)
    assert ds.neighbour_descent(df, 5).orderBy("id", "rank").collect() == several


def test_fuzzy_weights(spark):
    x = crowded(n=60)
    knn = nb.knn_graph(frame(spark, x), 5, "euclidean")
    rows = nb.fuzzy_knn_graph(knn, 5).collect()
    assert all(r.a < r.b and 0 < r.weight <= 1 + 1e-12 for r in rows)
    pairs = {tuple(sorted((r.id, r.neighbour))) for r in knn.collect()}
    assert {(r.a, r.b) for r in rows} == pairs


def test_any_encoder_in_batches(spark):
    docs = spark.createDataFrame([(i, "w" * i) for i in range(25)] + [(25, None)], "doc_id long, text string").coalesce(1)

    def encoder(texts):
        assert len(texts) <= 10
        return np.array([[len(t), 1.0] for t in texts])

    got = {r.doc_id: r.embedding for r in en.embed_documents(docs, encoder, batch_size=10).collect()}
    assert got == {**{i: [float(i), 1.0] for i in range(25)}, 25: [0.0, 1.0]}


def test_hashed_encoder():
    encode = en.HashedEncoder(32)
    a, b, c, empty = encode(["red apples", "apples, RED!", "green pears", ""])
    assert np.allclose(a, b) and not np.allclose(a, c) and not empty.any()
    assert math.isclose(np.linalg.norm(a), 1.0)
    many = encode([" ".join(f"term{i}" for i in range(5000))])
    assert np.isfinite(many).all()


def test_a_rare_far_cluster_gets_a_start(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (20_000, 3)), [[600.0, 600.0, 600.0]]])
    (start,) = cl.initial_centres(frame(spark, x), [cl.Spec(5)], "embedding", None)
    assert (np.linalg.norm(start - 600.0, axis=1) < 1e-9).any()
    again = cl.initial_centres(frame(spark, x[::-1].copy()), [cl.Spec(5)], "embedding", None)[0]
    assert np.allclose(start, again)


def test_rank_limit_of_copies_acts_before_the_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    few = Window.partitionBy("v").orderBy("id")
    limited = spark.range(100).select("id", (F.col("id") % 3).alias("v")).select("id", "v", F.row_number().over(few).alias("copy")).where("copy <= 3")
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_streamed_links_join_what_partitions_join(spark, metric, monkeypatch):
    x = np.random.default_rng(9).normal(size=(160, 3))
    x[130:] = x[:30]
    points = nb.metric_points(frame(spark, x), metric, "doc_id", "embedding")
    clean = np.array([r.v for r in points.orderBy("id").collect()])
    d = np.sqrt(((clean[:, None] - clean[None]) ** 2).sum(-1))
    d = d * d / 2 if metric == "cosine" else d
    for share in (0.4, 1.5):
        radius = round(float(np.quantile(d, share / 100)), 9)
        want = nb.components(np.round(d, 9) <= radius)
        for stream, rows in ((-1.0, 2), (9.0, 16)):
            monkeypatch.setattr(nb, "STREAM_SHARE", stream)
            found = de.connected_components(nb.radius_forest(points, radius, metric, block_rows=rows)).collect()
            root = np.arange(len(x))
            for r in found:
                root[r.id] = r.root
            assert (root == want).all() and len(set(want.tolist())) > (share < 1)


def test_far_links_store_no_copies_of_points(spark, monkeypatch):
    """Points that would visit most partitions: what is written stays in proportion to their number."""
    written, kept = {}, nb.materialise

    def watched(df, label="step"):
        out = kept(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(nb, "materialise", watched)
    points = frame(spark, np.random.default_rng(2).normal(size=(600, 16))).selectExpr("doc_id AS id", "embedding AS v")
    nb.radius_forest(points, 3.0, block_rows=20).count()
    assert max(written.values()) == 600


def test_sifting_in_single_precision_loses_nothing(spark):
    """Lengths of all orders, near copies, and vectors that single precision cannot hold."""
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e-20, 1e18, 1e60):
        x = rng.normal(size=(90, 5)) * scale
        x[1::9] = x[::9] + rng.normal(size=(10, 5)) * scale * 1e-6
        x[:3] *= 1000
        ids = np.arange(90)
        table = pa.table({"id": ids, "v": pa.array(list(x)), "asks": np.ones(90, bool)})
        near = nb._Nearest(table, 4, "euclidean")
        for begin in range(0, 90, 25):
            near.add(table.slice(begin, 25))
        diff = x[:, None] - x[None]
        cols, d = nb.smallest(np.sqrt((diff * diff).sum(-1)), ids, 4)
        assert (near.found == cols).all() and np.allclose(near.d, d, rtol=1e-12)
