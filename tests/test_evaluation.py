from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.operators import evaluate as ev
from callweave.operators import filters as fl
from callweave.operators import hierarchy as hi
from callweave.operators import selection as se
from callweave.operators import topics as tp
from callweave.operators.model import TopicModel
from callweave.sources import stores
from tests.test_vectors import crowded, frame, planted


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if len(set(labels)) < 2:
        return -1.0
    scores = []
    for i, own in enumerate(labels):
        mates = [j for j in range(len(x)) if labels[j] == own and j != i]
        if not mates:
            scores.append(0.0)
            continue
        a = d[i, mates].mean()
        b = min(d[i, labels == other].mean() for other in set(labels) if other != own)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("block_rows", [20, 4096])
def test_silhouette_many(spark, block_rows):
    x = crowded(n=90)
    rng = np.random.default_rng(2)
    labels = np.stack([rng.integers(-1, 4, 90), np.arange(90) // 45, np.zeros(90, int), np.r_[0, np.ones(89, int)]], 1)
    df = frame(spark, x).join(
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(labels)], "doc_id long, labels array<int>"), "doc_id"
    )
    got = {r.pos: r.silhouette for r in ev.silhouette_many(df, block_rows=block_rows).collect()}
    for m in range(4):
        assert abs(got[m] - brute_silhouette(x, labels[:, m])) < 1e-9, m


def test_silhouette_in_groups_of_labellings(spark, monkeypatch):
    """Labellings that do not fit together are scored in groups; more clusters make smaller blocks."""
    monkeypatch.setattr(ev, "SHARED_CLUSTERS", 5)
    monkeypatch.setattr(ev, "HELD_SUMS", 300)
    monkeypatch.setattr(ev, "LEAST_ROWS", 7)
    assert ev._shared([2, 3, 1, 4, 40, 2]) == [[0, 1], [3], [4], [5]]
    x = crowded(n=90)
    labels = np.stack([np.arange(90) % k for k in (2, 3, 1, 4, 40, 90)], 1)
    df = frame(spark, x).join(
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(labels)], "doc_id long, labels array<int>"), "doc_id"
    )
    got = {r.pos: (r.silhouette, r.clusters) for r in ev.silhouette_many(df).collect()}
    for m in range(6):
        assert abs(got[m][0] - brute_silhouette(x, labels[:, m])) < 1e-9 and got[m][1] == len(set(labels[:, m]))


def test_silhouette_shuffles_rows_only(spark):
    """One exchange moves copies of the rows; what follows moves one row a block and labelling."""
    df = frame(spark, crowded(n=60)).withColumn("labels", F.array((F.col("doc_id") % 3).cast("int")))
    scored = ev.silhouette_many(df, block_rows=20)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan and "labels" not in plan.split("MapInArrow")[0]


def test_silhouette_by_fold(spark):
    x = crowded(n=80)
    df = frame(spark, x).withColumn("fold", (F.col("doc_id") % 3).cast("int")).withColumn("topic", ((F.col("doc_id") * 7) % 4).cast("int"))
    got = ev.silhouette_many(df.withColumn("labels", F.array("topic")), group="fold", block_rows=10).collect()
    ids = np.arange(80)
    for r in got:
        mine = ids % 3 == r.part
        assert abs(r.silhouette - brute_silhouette(x[mine], (ids[mine] * 7) % 4)) < 1e-9


def test_single_clusters_need_no_distances(spark, monkeypatch):
    df = frame(spark, crowded(n=40)).withColumn("labels", F.array(F.lit(3), F.lit(-1)))
    monkeypatch.setattr(ev, "owned_blocks", None)
    got = ev.silhouette_many(df).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 0, -1.0, 1), (0, 1, -1.0, 1)]


def brute_windows(docs, window):
    out = []
    for d in docs:
        out += [set(d[s : s + window]) for s in range(max(1, len(d) - window + 1))]
    return out


@pytest.mark.parametrize("window", [3, 6])
@pytest.mark.parametrize("listed", [True, False])
def test_cooccurrence_matches_brute_force(spark, window, listed, monkeypatch):
    if not listed:
        monkeypatch.setattr(ev, "word_set", lambda words: None)
    rng = np.random.default_rng(window)
    docs = [[str(w) for w in rng.choice(list("abcdefgh"), size=n)] for n in (0, 1, 4, 9, 25, 40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(w,) for w in "abcz"], "word string")
    pairs = spark.createDataFrame(list(combinations("abcz", 2)), "a string, b string")
    single, both, windows = ev.window_cooccurrence(df, pairs, words, window)
    seen = brute_windows(docs, window)
    assert windows.first()[0] == len(seen)
    assert {r.word: r.n for r in single.collect()} == {w: sum(w in s for s in seen) for w in "abc"}
    want = {(a, b): sum(a in s and b in s for s in seen) for a, b in combinations("abcz", 2)}
    assert {(r.a, r.b): r.n for r in both.collect()} == want


def brute_cv(docs, words, window=110, eps=1e-12):
    seen = brute_windows(docs, window)
    p = {w: np.mean([w in s for s in seen]) for w in words}
    x = np.zeros((len(words), len(words)))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if p[a] > 0 and p[b] > 0:
                pab = np.mean([a in s and b in s for s in seen])
                x[i, j] = np.log((pab + eps) / (p[a] * p[b])) / -np.log(pab + eps)
    t = x.sum(0)
    return np.mean([v @ t / np.sqrt((v @ v) * (t @ t)) if v.any() and t.any() else 0.0 for v in x])


def texts(seed=0, n=12):
    rng = np.random.default_rng(seed)
    return [[str(w) for w in rng.choice(list("abcdefgh"), size=rng.integers(1, 30))] for _ in range(n)]


def test_coherence_and_held_out_folds(spark):
    docs = texts()
    df = spark.createDataFrame([(i, i % 3, d) for i, d in enumerate(docs)], "doc_id long, fold int, tokens array<string>")
    topics = {0: "abc", 1: "cdez", -1: "gh"}
    rows = [(t, w) for t, ws in topics.items() for w in ws]
    words = spark.createDataFrame(rows, "topic int, word string")
    got = {r.topic: r.coherence for r in ev.coherence_cv(df, words, window=5).collect()}
    assert got.keys() == {0, 1}
    assert all(abs(got[t] - brute_cv(docs, list(topics[t]), 5)) < 1e-9 for t in got)
    models = words.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    held = ev.coherence_cv(df, models, ["model", "topic"], window=5, fold="fold").collect()
    assert len(held) == 6
    for r in held:
        train = [d for i, d in enumerate(docs) if i % 3 != r.model]
        assert abs(r.coherence - brute_cv(train, list(topics[r.topic]), 5)) < 1e-9


def brute_ward(x):
    clusters = {i: (1, v) for i, v in enumerate(x)}
    merges, nxt = [], len(x)
    while len(clusters) > 1:
        best = min(
            ((2 * na * nb / (na + nb)) ** 0.5 * np.linalg.norm(a - b), i, j)
            for (i, (na, a)), (j, (nb, b)) in combinations(sorted(clusters.items()), 2)
        )
        d, i, j = best
        (na, a), (nb, b) = clusters.pop(i), clusters.pop(j)
        clusters[nxt] = (na + nb, (na * a + nb * b) / (na + nb))
        merges.append((i, j, d, na + nb))
        nxt += 1
    return merges


@pytest.mark.parametrize("block_rows", [6, 4096])
def test_merge_tree(spark, block_rows):
    x = np.random.default_rng(8).normal(size=(14, 4))
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "topic int, centre array<double>")
    got = hi.topic_hierarchy(centres, block_rows).orderBy("step").collect()
    want = brute_ward(x)
    assert [(r.left, r.right, r.size) for r in got] == [(i, j, s) for i, j, _, s in want]
    assert np.allclose([r.distance for r in got], [d for _, _, d, _ in want])
    assert [r.above_cut for r in got] == [d > 0.7 * max(m[2] for m in want) for _, _, d, _ in want]


def scores(spark, rows):
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def test_choice_of_k(spark):
    df = scores(spark, [(5, 100.0, 0.2), (10, 60.0, 0.4), (15, 50.0, 0.4), (20, 45.0, -1.0)])
    assert se.argmax_k(df).first().k == 10
    assert [r.d2 for r in se.second_difference(df).orderBy("k").collect()] == [30.0, 5.0]
    assert se.elbow_k(df).first().elbow == 10
    assert se.elbow_k(df, literal=True).first().elbow == 5
    assert se.argmax_k(scores(spark, [(5, 1.0, -1.0)])).count() == 0


def test_grid():
    assert se.param_grid({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def labelled_docs(spark, x):
    words = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    rows = [(i, (words[i // 20] + f" filler{i % 5}").split() * 3) for i in range(len(x))]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_sweep_finds_the_planted_number(spark):
    x = planted(seed=11)
    df = frame(spark, x)
    table = {r.k: r for r in se.optimal_k(df, [2, 3, 4, 6]).collect()}
    assert [k for k, r in table.items() if r.best] == [3]
    swept = {r.k: r for r in se.k_sweep(labelled_docs(spark, x), df, [2, 3, 6]).collect()}
    assert max(swept, key=lambda k: swept[k].silhouette) == 3
    assert all(0 < r.coherence <= 1 + 1e-9 for r in swept.values())


def test_cross_validation(spark):
    x = planted(seed=12)
    rows = se.cross_validate(labelled_docs(spark, x), frame(spark, x), k=3, n_splits=4).collect()
    assert sorted(r.fold for r in rows) == [1, 2, 3, 4] and {r.n_cluster for r in rows} == {3}
    assert all(r.silhouette > 0.5 and 0 < r.coherence <= 1 + 1e-9 for r in rows)


def brute_fold(x, fold, f, k_start, dims, steps=20):
    """Silhouette of a fold's own vectors under the model fitted on the reduced other rows."""
    train = x[fold != f]
    values, vectors = np.linalg.eigh(np.cov(train.T))
    axes = vectors[:, np.argsort(values)[::-1][:dims]].T
    y = (x - train.mean(0)) @ axes.T
    centres = y[k_start]
    for _ in range(steps):
        near = np.linalg.norm(y[:, None] - centres[None], axis=2).argmin(1)
        centres = np.array([y[(near == j) & (fold != f)].mean(0) for j in range(len(centres))])
    return brute_silhouette(x[fold == f], near[fold == f])


def test_folds_are_scored_by_reduced_models_on_the_original_vectors(spark, tmp_path):
    x = planted(seed=12)
    df, docs = frame(spark, x), labelled_docs(spark, x)
    out = str(tmp_path)
    words = se.Vocabulary(stop=("alpha",), max_n=2, min_tf=3)
    rows = se.cross_validate(docs, df, k=3, n_splits=4, n_components=2, vocabulary=words, out=out).collect()
    fold = np.array([r.fold for r in fl.kfold_split(df, n_splits=4).orderBy("doc_id").collect()])
    for r in rows:  # planted groups: any start finds them
        assert abs(r.silhouette - brute_fold(x, fold, r.fold - 1, [0, 20, 40], 2)) < 1e-9
    info = spark.read.parquet(f"{out}/topic_info").collect()
    assert {r.run for r in info} == {0, 1, 2, 3, 4}
    for run in range(5):
        mine = [r for r in info if r.run == run]
        assert sum(r["count"] for r in mine) == (60 if run == 0 else int((fold != run - 1).sum()))
        assert all("alpha" not in r.words and any(" " in w for w in r.words) and r.name.startswith(f"{r.topic}_") for r in mine)
        model = TopicModel.load(spark, f"{out}/model_{run}")
        topics = np.array([r.topic for r in model.transform(df).orderBy("doc_id").collect()])
        assert len({tuple(sorted({*topics[a : a + 20]})) for a in (0, 20, 40)}) == 3 and model.centres.shape == (3, 2)
        new = frame(spark, x[:3] + 0.01, [100, 101, 102])
        assert [r.topic for r in model.transform(new).orderBy("doc_id").collect()] == topics[:3].tolist()
        assert {(r.topic, r.word) for r in model.words.collect()} == {(r.topic, w) for r in mine for w in r.words}
    with pytest.raises(FileNotFoundError):
        TopicModel.load(spark, f"{out}/model_9")


def test_documents_and_vectors_have_to_match(spark):
    x = planted(seed=12)
    docs = labelled_docs(spark, x)
    with pytest.raises(ValueError, match="one to one"):
        se.cross_validate(docs, frame(spark, x[:50]), k=3, n_splits=2)
    with pytest.raises(ValueError, match="one to one"):
        se.k_sweep(docs.limit(40), frame(spark, x), [3])
    a, b = se.matched(docs, frame(spark, x[:50]), "drop")
    assert a.count() == b.count() == 50


def test_rare_terms_are_judged_on_the_training_texts(spark):
    docs = spark.createDataFrame([(i, ["often", "rare"] if i == 0 else ["often", "seed"] if i == 1 else ["often"]) for i in range(6)], "doc_id long, tokens array<string>")
    labels = spark.createDataFrame([(i, m, 0) for i in range(6) for m in (0, 1) if not (m == 1 and i > 3)], "doc_id long, model int, topic int")
    words = se.Vocabulary(max_n=2, min_tf=4, seeds=("seed",))
    got = {(r.model, r.term): r.tf for r in se._model_terms(docs, labels, "tokens", "model", words).collect()}
    assert got == {(0, "often"): 6, (0, "seed"): 1, (1, "seed"): 1}


def test_sweep_stores_every_k(spark, tmp_path):
    x = planted(seed=11)
    out = str(tmp_path)
    swept = se.k_sweep(labelled_docs(spark, x), frame(spark, x), [2, 3], n_components=3, out=out).collect()
    assert {r.k for r in swept} == {2, 3}
    info = spark.read.parquet(f"{out}/topic_info").groupBy("run").agg(F.count("topic").alias("n"), F.sum("count").alias("docs")).collect()
    assert {(r.run, r.n, r.docs) for r in info} == {(2, 2, 60), (3, 3, 60)}
    assert TopicModel.load(spark, f"{out}/model_3").centres.shape == (3, 3)


def test_best_model_is_refitted_and_stored(spark, tmp_path):
    x = planted(seed=11)
    out = str(tmp_path)
    scores, model = se.fit_best(labelled_docs(spark, x), frame(spark, x), [2, 3, 5], n_components=2, out=out)
    assert [r.k for r in scores.where("best").collect()] == [3] and model.centres.shape == (3, 2)
    again = TopicModel.load(spark, f"{out}/model_3").transform(frame(spark, x)).orderBy("doc_id").collect()
    assert [r.topic for r in again] == [r.topic for r in model.transform(frame(spark, x)).orderBy("doc_id").collect()]
    assert spark.read.parquet(f"{out}/topic_info").select("run").distinct().collect() == [(3,)]


def test_grid_options_are_honoured_or_refused(spark):
    base = {"n_components": 2, "min_samples": 3, "min_cluster_size": 5}
    tables = {"a": frame(spark, planted(seed=13)), "b": frame(spark, planted(seed=14, groups=1, size=60))}
    rows = se.grid_search(tables, [{**base, "embedding_model": m} for m in "ab"] + [{**base, "embedding_model": "a", "min_dist": 0.1}]).collect()
    assert all(r.error is None for r in rows[:2]) and rows[1].score != rows[0].score and sum(r.best for r in rows) == 1
    assert rows[2].score is None and "min_dist" in rows[2].error


def test_grid_search_shares_its_steps(spark, monkeypatch):
    """The links for a number of neighbours, and the distances of all labellings, are computed once."""
    df = frame(spark, planted(seed=13))
    grid = se.param_grid({"n_components": [2], "min_samples": [3, 5], "min_cluster_size": [5, 10, 1000]})
    alone = [se.evaluate_density(df, params).first()["silhouette"] for params in grid]
    calls = []
    for name in ("pca_reduce", "knn_graph", "density_members", "silhouette_many"):
        def counted(*args, _name=name, _step=getattr(se, name), **kwargs):
            calls.append(_name)
            return _step(*args, **kwargs)

        monkeypatch.setattr(se, name, counted)
    rows = se.grid_search(df, grid).collect()
    assert sorted(calls) == ["density_members", "density_members", "knn_graph", "knn_graph", "pca_reduce", "silhouette_many"]
    assert np.allclose([r.score for r in rows], alone, atol=1e-9)


def test_models_multiply_terms_after_the_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, ["often", "rare", "often"][: 1 + i % 3]) for i in range(12)], "doc_id long, tokens array<string>")
    labels = spark.createDataFrame([(i, k, i % k) for i in (0, 1, 2, 2, 3) for k in (1, 2, 3)], "doc_id long, k int, topic int")
    for least in (0, 5):
        found = se._model_terms(docs, labels, "tokens", "k", se.Vocabulary(min_tf=least))
        plain = docs.select("doc_id", F.explode("tokens").alias("term")).join(labels, "doc_id").groupBy("k", "topic", "term").agg(F.count("term").alias("tf")).collect()
        total = {(r.k, r.term): sum(s.tf for s in plain if (s.k, s.term) == (r.k, r.term)) for r in plain}
        want = sorted((r.k, r.topic, r.term, r.tf) for r in plain if total[r.k, r.term] > least)
        assert sorted((r.k, r.topic, r.term, r.tf) for r in found.select("k", "topic", "term", "tf").collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "_models" in plan and "Exchange" not in plan[: plan.index("Generate explode(_models")]


def test_blocks_have_a_task_each(spark):
    from callweave.operators.cells import owned_blocks

    def finish(state):
        return pa.RecordBatch.from_arrays([pa.array([state])], ["n"])

    points = spark.range(2000).selectExpr("id", "0 AS part")
    found = owned_blocks(points, lambda part, job, own: len(own), lambda state, others: None, finish, "n long", "id", {(0, 0): 23})
    rows = found.select("n", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len({r.task for r in rows}) == 23 and sum(r.n for r in rows) == 2000


@pytest.mark.parametrize("fold", [None, "fold"])
def test_windows_in_arrays_equal_joined_runs(spark, monkeypatch, fold):
    rng = np.random.default_rng(8)
    rows = [(int(i) % 25, int(i) % 3 if i < 25 else int(i - 25) % 3, [f"w{w}" for w in rng.integers(0, 12, int(rng.integers(1, 60)))]) for i in range(30)]
    rows += [(90, 1, []), (91, 2, ["other"])]
    docs = spark.createDataFrame(rows, "doc_id long, fold int, tokens array<string>")
    words = spark.createDataFrame([(m, t, f"w{(t * 3 + j) % 14}") for m in range(3) for t in range(3) for j in range(4)], "model int, topic int, word string")
    pairs = ev.word_pairs(words, ["model", "topic"])

    def counts():
        single, both, windows = ev.cooccurrence_by_fold(docs, pairs, words, 7, fold=fold)
        return (
            {(r.fold, r.word): r.n for r in single.collect()}, {(r.fold, r.a, r.b): r.n for r in both.where("n > 0").collect()},
            {r.fold: r.windows for r in windows.collect()},
        )

    with monkeypatch.context() as m:
        m.setattr(ev, "HELD_PAIRS", -1)
        joined = counts()
    with monkeypatch.context() as m:
        m.setattr(ev, "_islands", None)
        assert counts() == joined


def test_bend_needs_no_silhouettes(spark, sf, monkeypatch):
    from callweave.plans import QUERIES

    monkeypatch.setattr(ev, "silhouette_many", None)
    assert QUERIES["elbow_k"](spark, sf).count() == 1 and QUERIES["second_difference"](spark, sf).count() == 6


def test_grid_search_keeps_failures(spark):
    grid = se.param_grid({"n_components": [2], "min_samples": [3], "min_cluster_size": [10, 1000]}) + [{"n_components": 2}]
    rows = se.grid_search(frame(spark, planted(seed=13)), grid).collect()
    assert [r.best for r in rows] == [True, False, False]
    assert rows[1].score == -1.0 and rows[1].error is None
    assert rows[2].score is None and "KeyError" in rows[2].error
    with pytest.raises(RuntimeError):
        se.grid_search(frame(spark, planted()), [{"n_components": 2}])


def test_class_weights(spark):
    terms = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b"), (1, "c")], "topic int, term string")
    got = {(r.topic, r.term): r.score for r in tp.class_tfidf(terms).collect()}
    assert abs(got[(0, "a")] - 2 / 3 * np.log(1 + 2 / 2)) < 1e-12
    assert abs(got[(1, "b")] - 1 / 2 * np.log(1 + 2 / 2)) < 1e-12
    exact = {(r.topic, r.term): r.score for r in tp.class_tfidf(terms, whole_average=False).collect()}
    assert abs(exact[(1, "c")] - 1 / 2 * np.log(1 + 2.5 / 1)) < 1e-12


def test_topic_runs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "info")
    stores.save_topic_info(spark.createDataFrame([(0, 5, "a"), (0, 6, "b")], "topic int, n int, run string"), path)
    stores.save_topic_info(spark.createDataFrame([(1, 9, "b")], "topic int, n int, run string"), path)
    assert {(r.run, r.topic, r.n) for r in spark.read.parquet(path).collect()} == {("a", 0, 5), ("b", 1, 9)}


def test_words_of_many_models_are_those_of_their_terms(spark, monkeypatch):
    """Terms that go on from batch to batch, lists cut in pieces, equal weights, a model that names a document twice, rare terms."""
    monkeypatch.setattr(se, "TERM_CELLS", 20)
    monkeypatch.setattr(se, "ROW_TOPICS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(3)
        rows = [(i % 35, [f"t{int(t)}" for t in rng.zipf(1.4, 12) % 40]) for i in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
        labels = [(i, k, int(rng.integers(k)) - (k == 4)) for i in range(33) for k in (1, 4, 9)] + [(2, 4, 0), (2, 4, 0)]
        labels = spark.createDataFrame(labels, "doc_id long, k int, topic int")
        for words in (se.Vocabulary(), se.Vocabulary(stop=("t1",), max_n=2, min_tf=3, seeds=("t17",))):
            plain = se._topic_words(se._model_terms(docs, labels, "tokens", "k", words), ["k", "topic"], 4)
            found = se._model_words(docs, labels, "tokens", "k", words, 4)
            want = {(r.k, r.topic, r.rank): (r.word, round(r.score, 9)) for r in plain.collect()}
            assert len(want) > 30 and {(r.k, r.topic, r.rank): (r.word, round(r.score, 9)) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_models_write_a_list_a_term(spark, monkeypatch):
    """No table grows by terms times topics: what is written holds a row a term (lists are not cut here), or a few a topic and task."""
    docs = spark.createDataFrame([(i, [f"t{j}" for j in range(20)]) for i in range(60)], "doc_id long, tokens array<string>")
    labels = spark.createDataFrame([(i, k, i % k) for i in range(60) for k in range(2, 12)], "doc_id long, k int, topic int")
    written, kept = {}, se.materialise

    def watched(df, label="step"):
        out = kept(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(se, "materialise", watched)
    monkeypatch.setattr(tp, "materialise", watched)
    se._model_words(docs, labels, "tokens", "k", se.Vocabulary(), 3)
    assert written["term-topics"] == 20 and "class-terms" not in written and written["words"] == 3 * sum(range(2, 12))


def test_sums_to_many_clusters(spark, monkeypatch):
    """Sums by product and by rows, for copies of rows as well."""
    x = np.random.default_rng(5).normal(size=(70, 3))
    x[60:] = x[:10]
    labels = np.stack([np.arange(70) % 10, np.arange(70) % 5, np.arange(70) // 30], 1)
    df = frame(spark, x).join(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(labels)], "doc_id long, labels array<int>"), "doc_id")
    for clusters in (0, 32):
        monkeypatch.setattr(ev, "PRODUCT_CLUSTERS", clusters)
        got = {r.pos: r.silhouette for r in ev.silhouette_many(df, block_rows=16).collect()}
        assert all(abs(got[m] - brute_silhouette(x, labels[:, m])) < 1e-9 for m in range(3))
