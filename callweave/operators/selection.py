"""Model selection: folds, grids and sweeps over the number of topics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import text as tx
from callweave.operators.cluster import Spec, fit_many, fit_minibatch, label_many
from callweave.operators.density import density_labels, density_members, density_topics
from callweave.operators.evaluate import coherence_cv, silhouette_exact, silhouette_many
from callweave.operators.filters import kfold_split, require_alignment, sample_rows
from callweave.operators.matrix import cells_of
from callweave.operators.model import TopicModel
from callweave.operators.neighbours import knn_graph
from callweave.operators.reduce import Projection, fit_projection, holdout_projections, moments, pca_reduce, project
from callweave.operators.topics import RANK_DIGITS, class_tfidf, filter_empty_topics, topic_sizes, topk_terms
from callweave.operators.vocab import term_array
from callweave.session import checked_broadcast, materialise, spread_by
from callweave.sources.stores import save_topic_info


def fold_means(scores: DataFrame, *columns: str) -> DataFrame:
    """Mean of each score over the folds, one column each."""
    return scores.agg(*[F.avg(c).alias(c) for c in columns])


def argmax_k(scores: DataFrame, score: str = "silhouette", k: str = "k") -> DataFrame:
    """First k with the highest score; a score of -1 marks an invalid model and never wins."""
    return scores.where(F.col(score) > -1).orderBy(F.desc(score), k).limit(1).select(k, score)


def second_difference(scores: DataFrame, value: str = "inertia", k: str = "k") -> DataFrame:
    """Second difference of a value over k, at the middle one of three. One row per model."""
    order = Window.orderBy(k)
    d2 = F.lead(value).over(order) - 2 * F.col(value) + F.lag(value).over(order)
    return scores.select(k, value, d2.alias("d2")).where("d2 is not null")


def elbow_k(scores: DataFrame, value: str = "inertia", k: str = "k", literal: bool = False) -> DataFrame:
    """k with the greatest second difference.

    ``literal`` gives the position of that maximum plus the smallest k instead.
    """
    d2 = second_difference(scores, value, k)
    place = F.row_number().over(Window.orderBy(k)) - 1
    ranked = d2.withColumn("_place", place).orderBy(F.desc("d2"), k).limit(1)
    if literal:
        return ranked.select((F.col("_place") + scores.agg(F.min(k)).scalar()).cast("int").alias("elbow"))
    return ranked.select(F.col(k).cast("int").alias("elbow"))


def param_grid(options: dict[str, list]) -> list[dict]:
    """Every combination of the option lists, in their order."""
    return [dict(zip(options, values)) for values in product(*options.values())]


def matched(docs: DataFrame, points: DataFrame, unmatched: str = "error", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents and vectors of the same ids. One without the other is an error, or left out if ``unmatched`` is ``drop``."""
    if unmatched == "error":
        require_alignment(docs, points, key)
        return docs, points
    if unmatched != "drop":
        raise ValueError("unmatched is error or drop")
    left, right = checked_broadcast(docs.select(key)), checked_broadcast(points.select(key))
    # The documents that have a vector may lie in a few files: they are spread again.
    return spread_by(docs.join(right, key, "left_semi"), key), points.join(left, key, "left_semi")


@dataclass(frozen=True)
class Vocabulary:
    """Which terms of a document describe its topic: words and, with ``max_n`` of 2, pairs of neighbours, both without ``stop`` words.

    A term has to occur more than ``min_tf`` times in the texts a model is fitted on, unless it is a seed word.
    """

    stop: tuple[str, ...] = ()
    max_n: int = 1
    min_tf: int = 0
    seeds: tuple[str, ...] = ()


# Cells of an array of terms and topics that a task counts at once, and topics that a row of counts names at most.
TERM_CELLS, ROW_TOPICS = 1 << 21, 256


def _counted_terms(docs: DataFrame, packed: DataFrame, tokens: str, name: str, vocabulary: Vocabulary) -> DataFrame:
    """Terms of every document, counted, with its topics in all models: ``packed`` has ``doc_id, _models``.

    A term that is rare in all texts is rare in every model, and most terms are: they go before the models multiply the counts.
    """
    terms = term_array(F.col(tokens), list(vocabulary.stop), vocabulary.max_n)
    rows = docs.select("doc_id", F.explode(tx.each(terms)).alias("term"))
    if vocabulary.min_tf:
        packed = materialise(packed, "models")
        copies = F.size("_models") - F.size(F.array_distinct(F.transform("_models", lambda m: m[name]))) + 1
        most = packed.agg(F.max(copies)).first()[0] or 1
        total = rows.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
        kept = total.where((F.col("_n") * most > vocabulary.min_tf) | F.col("term").isin(*vocabulary.seeds)).select("term")
        rows = rows.join(checked_broadcast(kept), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).join(packed, "doc_id")


def _model_terms(docs: DataFrame, labels: DataFrame, tokens: str, name: str = "k", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Terms of every topic of each model, counted per document before the models multiply them.

    The vocabulary of a model comes from the same counts: they hold just the documents that it is fitted on.
    """
    # One row a document with its topics in all models; a model that names a document twice counts it twice.
    packed = labels.groupBy("doc_id").agg(F.collect_list(F.struct(name, "topic")).alias("_models"))
    counted = _counted_terms(docs, packed, tokens, name, vocabulary)
    # Rows meet by their term alone: the models multiply them afterwards, inside a partition, and nothing that they multiplied is shuffled.
    own = spread_by(counted, "term").select("term", "tf", F.explode("_models").alias("m"))
    found = own.groupBy(F.col(f"m.{name}").alias(name), F.col("m.topic").alias("topic"), "term").agg(F.sum("tf").alias("tf"))
    if not vocabulary.min_tf:
        return found
    often = F.sum("tf").over(Window.partitionBy(name, "term")) > vocabulary.min_tf
    return found.withColumn("_often", often).where(F.col("_often") | F.col("term").isin(*vocabulary.seeds)).drop("_often")


@dataclass(frozen=True)
class _Topics:
    """The topics of all models in one numbering, those of a model side by side, and the vocabulary that a model's own counts decide."""

    models: np.ndarray  # the model of each topic, counted from zero
    vocabulary: Vocabulary

    def rows(self, terms: list[str], tf: np.ndarray) -> pa.RecordBatch:
        """Counts of terms (rows) by topics (columns) as lists, without those that the vocabulary of a model leaves out."""
        first = np.flatnonzero(np.diff(self.models, prepend=-1))
        f_t = np.add.reduceat(tf, first, axis=1)
        seed = np.array([t in self.vocabulary.seeds for t in terms])
        often = (f_t > self.vocabulary.min_tf) | (seed[:, None] if self.vocabulary.min_tf else True)
        row, topic = cells_of((tf > 0) & often[:, self.models])
        n = np.bincount(row, minlength=len(terms))
        pieces = -(-n // ROW_TOPICS)
        of = np.repeat(np.arange(len(terms)), pieces)
        begin = (np.cumsum(n) - n)[of] + ROW_TOPICS * (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of])
        offsets = pa.array(np.append(begin, len(row)).astype(np.int32))
        lists = topic.astype(np.int32), tf[row, topic].astype(np.int64), f_t[row, self.models[topic]].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([terms[i] for i in of.tolist()], pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists)], ["term", "topics", "tf", "f_t"]
        )

    def count(self, batches):
        """Rows of a term with the topics of a document, sorted by term, added up: ``term, topics, tf, f_t``."""
        width = len(self.models)
        step = max(1, TERM_CELLS // width)
        last, open_ = None, None  # the term that the next rows may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("term").dictionary_encode()
            terms, numbers = coded.dictionary.to_pylist(), batch.column("_numbers")
            each = np.repeat(np.arange(batch.num_rows), numbers.value_lengths().to_numpy(zero_copy_only=False))
            term = coded.indices.to_numpy(zero_copy_only=False)[each].astype(np.int64)
            topic, tf = numbers.flatten().to_numpy(zero_copy_only=False), batch.column("tf").to_numpy(zero_copy_only=False)[each]
            for begin in range(0, len(terms), step):
                some = terms[begin : begin + step]
                part = slice(*np.searchsorted(term, [begin, begin + len(some)]))
                sums = np.bincount((term[part] - begin) * width + topic[part], tf[part], len(some) * width).reshape(len(some), width)
                if last == some[0]:
                    sums[0] += open_
                elif last is not None:
                    yield self.rows([last], open_[None, :])
                last, open_ = some[-1], sums[-1].copy()
                if len(some) > 1:
                    yield self.rows(some[:-1], sums[:-1])
        if last is not None:
            yield self.rows([last], open_[None, :])

    def sizes(self, batches):
        """Counted terms of each topic."""
        n = np.zeros(len(self.models))
        for batch in batches:
            n += np.bincount(batch.column("topics").flatten(), batch.column("tf").flatten(), len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["number", "n_c"])

    def leaders(self, n_c: np.ndarray, top: int):
        """A function that gives of each topic the ``top`` terms of its rows which weigh most, in the order of :func:`topk_terms`."""
        counted, models = n_c > 0, self.models
        mean = np.floor(np.bincount(models, n_c) / np.maximum(np.bincount(models, counted), 1))

        def run(batches):
            held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            words, least = pa.array([], pa.string()), np.full(len(models), -np.inf)
            of = np.zeros(0, np.int64)  # the word of each row held
            for batch in batches:
                topics = batch.column("topics")
                topic, tf, f_t = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("topics", "tf", "f_t"))
                score = np.round(tf / n_c[topic] * np.log(1 + mean[models[topic]] / f_t), RANK_DIGITS)
                use = np.flatnonzero(score >= least[topic])
                word = np.repeat(np.arange(batch.num_rows), topics.value_lengths().to_numpy(zero_copy_only=False))[use]
                both = pa.concat_arrays([words, batch.column("term").cast(pa.string())])
                place = pc.rank(both, tiebreaker="dense").to_numpy()
                held = [np.concatenate([a, b[use]]) for a, b in zip(held, (topic, score, tf, f_t))]
                of = np.concatenate([of, len(words) + word])
                order = np.lexsort((place[of], -held[1], held[0]))
                topic = held[0][order]
                order = order[np.arange(len(order)) - np.searchsorted(topic, topic) < top]
                held, of = [x[order] for x in held], of[order]
                names, of = np.unique(of, return_inverse=True)
                words = both.take(pa.array(names))
                full = np.flatnonzero(np.bincount(held[0], minlength=len(models)) >= top)
                least[full] = held[1][np.searchsorted(held[0], full, side="right") - 1]
            if len(of):
                rows = [pa.array(held[0].astype(np.int32)), words.take(pa.array(of)), pa.array(held[2]), pa.array(held[3])]
                yield pa.RecordBatch.from_arrays(rows, ["number", "term", "tf", "f_t"])

        return run


def _model_words(docs: DataFrame, labels: DataFrame, tokens: str, name: str, vocabulary: Vocabulary, top: int) -> DataFrame:
    """What :func:`_topic_words` gives for the terms of :func:`_model_terms`, for many models.

    Models multiply the terms inside a task, in arrays of terms and topics, and what is written is one list of counts a term. The weights need the
    size of every topic, a row a topic; then a task keeps of each topic the terms that may be among its first ones.
    """
    listed = sorted(tuple(r) for r in labels.select(name, "topic").distinct().collect())  # one row a topic of a model
    if not listed:
        return _topic_words(_model_terms(docs, labels, tokens, name, vocabulary), [name, "topic"], top)
    schema = f"{name} {labels.schema[name].dataType.simpleString()}, topic {labels.schema['topic'].dataType.simpleString()}"
    spark = docs.sparkSession
    numbers = F.broadcast(spark.createDataFrame([(*key, i) for i, key in enumerate(listed)], f"{schema}, number int"))
    names = list(dict.fromkeys(key[0] for key in listed))
    topics = _Topics(np.array([names.index(key[0]) for key in listed]), vocabulary)
    packed = labels.join(numbers, [name, "topic"]).groupBy("doc_id").agg(
        F.collect_list(F.struct(name, "topic")).alias("_models"), F.collect_list("number").alias("_numbers")
    )
    counted = _counted_terms(docs, packed, tokens, name, vocabulary).select("term", "tf", "_numbers")
    lists = spread_by(counted, "term").sortWithinPartitions("term").mapInArrow(topics.count, "term string, topics array<int>, tf array<long>, f_t array<long>")
    lists = materialise(lists, "term-topics")
    sizes = materialise(lists.mapInArrow(topics.sizes, "number int, n_c long").groupBy("number").agg(F.sum("n_c").alias("n_c")), "topic-sizes")
    n_c = np.zeros(len(listed))
    for r in sizes.collect():  # one row a topic of a model
        n_c[r.number] = r.n_c
    leaders = lists.mapInArrow(topics.leaders(n_c, top), "number int, term string, tf long, f_t long").join(numbers, "number").drop("number")
    by = [name, "topic"]
    return materialise(topk_terms(class_tfidf(leaders, by, sizes=sizes.join(numbers, "number").drop("number")), top, by), "words")


def _topic_words(terms: DataFrame, by: list[str], top: int) -> DataFrame:
    return materialise(topk_terms(class_tfidf(terms, by), top, by), "words")


def _single(words: DataFrame) -> DataFrame:
    """Words without pairs: the texts that coherence looks at are lists of single tokens."""
    return words.where(~F.col("word").contains(" "))


def topic_tables(labels: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """``run, topic, count, name, words`` of every model: what a run stores about its topics."""
    by = [name, "topic"]
    lists = filter_empty_topics(words).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words"))
    label = F.concat(F.col("topic").cast("string"), F.lit("_"), F.array_join(F.slice("words", 1, 4), "_"))
    return topic_sizes(labels, by).join(lists, by, "left").select(F.col(name).cast("int").alias("run"), "topic", "count", label.alias("name"), "words")


def sweep(
    points: DataFrame, ks: list[int], sample: int | None = 10_000, max_iter: int = 20, seed: int = 42, n_components: int | None = 5,
    batches: int | None = None,
) -> tuple[DataFrame, DataFrame, list[np.ndarray], Projection | None]:
    """Fit one model per k and score it.

    Returns ``k, inertia, silhouette``, the labels ``doc_id, k, topic``, the centres and the projection. The models are fitted on ``n_components``
    leading components of all rows (on the vectors themselves if none are asked for), the silhouette is that of the vectors. All models are fitted in
    the same passes and share one pass over the distances for their silhouettes. With ``batches`` they are fitted by small steps.
    """
    spark = points.sparkSession
    slim = points.select("doc_id", "embedding")
    fitted = fit_projection(moments(slim), n_components) if n_components else None
    slim = materialise(project(slim, fitted) if fitted else slim.withColumn("reduced", F.col("embedding")), "sweep")
    specs = [Spec(k) for k in ks]
    if batches:
        centres, inertia = fit_minibatch(slim, specs, "reduced", batches=batches)
    else:
        centres, inertia = fit_many(slim.select("reduced"), specs, "reduced", max_iter=max_iter)
    labelled = materialise(label_many(slim, centres, "reduced").drop("reduced"), "labels")
    scored = labelled if sample is None else sample_rows(labelled, "doc_id", sample, seed)
    scores = silhouette_many(scored).select("pos", "silhouette")
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(ks, inertia))], "pos int, k int, inertia double")
    numbers = F.array(*[F.lit(k) for k in ks])
    labels = labelled.select("doc_id", F.explode(F.arrays_zip(numbers.alias("k"), "labels")).alias("m")).select(
        "doc_id", F.col("m.k").alias("k"), F.col("m.labels").alias("topic")
    )
    return table.join(scores, "pos").select("k", "inertia", "silhouette"), labels, centres, fitted


def _store(out: str, runs: list[int], centres: list[np.ndarray], lens: list[Projection | None], words: DataFrame, name: str, tables: DataFrame) -> None:
    """Topic tables of all runs, and each run as a model."""
    save_topic_info(tables, f"{out}/topic_info")
    for run, c, lens_ in zip(runs, centres, lens):
        own = words.where(F.col(name) == run).select("topic", "rank", "word", "score")
        TopicModel(c, lens_, own).save(f"{out}/model_{run}")


def k_sweep(
    docs: DataFrame, points: DataFrame, ks: list[int], tokens: str = "tokens", top: int = 10, sample: int | None = None, n_components: int | None = 5,
    vocabulary: Vocabulary = Vocabulary(), unmatched: str = "error", out: str | None = None, batches: int | None = None,
) -> DataFrame:
    """Silhouette and coherence per number of topics: ``k, silhouette, coherence``.

    ``docs`` carries the terms of each document in ``tokens``. Term weights and coherence of all
    models come from shared passes; a word pair that many models use is counted once. With ``out`` the topic table of every k is
    stored there under its run, and every k as a model. With ``batches`` the models are fitted by small steps.
    """
    docs, points = matched(docs, points, unmatched)
    scores, labels, centres, fitted = sweep(points, ks, sample, n_components=n_components, batches=batches)
    texts = materialise(docs.select("doc_id", tokens), "docs")
    words = _model_words(texts, labels, tokens, "k", vocabulary, top)
    coherence = coherence_cv(texts, _single(words), ["k", "topic"], tokens=tokens)
    if out:
        _store(out, ks, centres, [fitted] * len(ks), words, "k", topic_tables(labels, words, "k"))
    return scores.join(coherence.groupBy("k").agg(F.avg("coherence").alias("coherence")), "k", "left").select(
        "k", "silhouette", "coherence"
    )


def fit_best(
    docs: DataFrame, points: DataFrame, ks: list[int] = tuple(range(5, 101, 5)), sample: int = 10_000, n_components: int | None = 5,
    tokens: str = "tokens", top: int = 10, vocabulary: Vocabulary = Vocabulary(), unmatched: str = "error", out: str | None = None,
) -> tuple[DataFrame, TopicModel]:
    """The scores of :func:`optimal_k`, and the model of the best k refitted on all rows (stored under ``out`` with its topic table, as run k)."""
    docs, points = matched(docs, points, unmatched)
    scores = materialise(optimal_k(points, ks, sample, n_components), "best")
    best = scores.where("best").first()
    if best is None:
        raise ValueError("no number of topics gives two clusters or more")
    return scores, refit(docs, points, best.k, tokens, top, n_components, vocabulary, out, best.k)


def optimal_k(
    points: DataFrame, ks: list[int] = tuple(range(5, 101, 5)), sample: int = 10_000, n_components: int | None = None, batches: int | None = None
) -> DataFrame:
    """``k, inertia, silhouette, best, elbow`` with the chosen k marked in ``best``; fitted on the vectors themselves unless ``n_components`` are asked for."""
    scores = materialise(sweep(points, list(ks), sample, n_components=n_components, batches=batches)[0], "scores")
    best, bend = argmax_k(scores).select("k").scalar(), elbow_k(scores).scalar()
    return scores.withColumn("best", F.col("k") == best).withColumn("elbow", F.col("k") == bend)


def cross_validate(
    docs: DataFrame, points: DataFrame, k: int, n_splits: int = 10, seed: int = 42, tokens: str = "tokens", top: int = 10, n_components: int | None = 5,
    vocabulary: Vocabulary = Vocabulary(), unmatched: str = "error", out: str | None = None,
) -> DataFrame:
    """``fold, n_cluster, silhouette, coherence`` per fold.

    A fold is scored by the model fitted without it: the projection, the centres, the vocabulary and the term weights come from the
    training rows; the silhouette is that of the fold's own vectors, the coherence that of the topics of the training rows on the training texts.
    All folds share every pass: the moments, the fits, the distances, the term counts and the scan for co-occurring words. With ``out`` the topic
    tables (runs 1 to ``n_splits``) and models of all folds are stored there, and as run 0 the model refitted on all rows.
    """
    docs, points = matched(docs, points, unmatched)
    split = materialise(kfold_split(points.select("doc_id", "embedding"), "doc_id", n_splits, seed), "folds")
    lens = holdout_projections(split, "fold", n_components) if n_components else None
    specs = [Spec(k, holdout=f) for f in range(n_splits)]
    centres, _ = fit_many(split, specs, fold="fold", lens=lens)
    labelled = materialise(label_many(split, centres, specs=specs, lens=lens), "labels")
    own = labelled.withColumn("own", F.array(F.element_at("labels", F.col("fold") + 1)))
    silhouettes = silhouette_many(own, "own", group="fold").select(F.col("part").alias("fold"), "silhouette")
    models = labelled.select("doc_id", "fold", F.posexplode("labels").alias("model", "topic")).where("model <> fold").select("doc_id", "model", "topic")
    trained = materialise(docs.join(labelled.select("doc_id", "fold"), "doc_id").select("doc_id", "fold", tokens), "train")
    words = _model_words(trained, models, tokens, "model", vocabulary, top)
    coherence = coherence_cv(trained, _single(words), ["model", "topic"], tokens=tokens, fold="fold")
    if out:
        lenses = [lens[f] if lens else None for f in range(n_splits)]
        shown = words.withColumn("model", F.col("model") + 1)
        tables = topic_tables(models.withColumn("model", F.col("model") + 1), shown, "model")
        _store(out, list(range(1, n_splits + 1)), centres, lenses, shown, "model", tables)
        refit(docs, points, k, tokens, top, n_components, vocabulary, out)
    per_fold = coherence.groupBy(F.col("model").alias("fold")).agg(F.avg("coherence").alias("coherence"))
    return silhouettes.join(per_fold, "fold", "left").select(
        (F.col("fold") + 1).alias("fold"), F.lit(k).alias("n_cluster"), "silhouette", "coherence"
    )


def refit(
    docs: DataFrame, points: DataFrame, k: int, tokens: str = "tokens", top: int = 10, n_components: int | None = 5,
    vocabulary: Vocabulary = Vocabulary(), out: str | None = None, run: int = 0,
) -> TopicModel:
    """The model with ``k`` topics fitted on all rows, stored with its topic table under ``out`` if that is given."""
    slim = points.select("doc_id", "embedding")
    fitted = fit_projection(moments(slim), n_components) if n_components else None
    lens = {None: fitted} if fitted else None
    centres, _ = fit_many(slim, [Spec(k)], lens=lens)
    labels = label_many(slim, centres, specs=[Spec(k)], lens=lens).select("doc_id", F.lit(run).alias("run"), F.col("labels")[0].alias("topic"))
    labels = materialise(labels, "labels")
    words = _topic_words(_model_terms(docs.select("doc_id", tokens), labels, tokens, "run", vocabulary), ["run", "topic"], top)
    model = TopicModel(centres[0], fitted, words.select("topic", "rank", "word", "score"))
    if out:
        save_topic_info(topic_tables(labels, words, "run"), f"{out}/topic_info")
        model.save(f"{out}/model_{run}")
    return model


# What a parameter set may name; an option of another reduction is refused, not passed over.
GRID_OPTIONS = {"n_components", "min_samples", "min_cluster_size", "metric", "embedding_model"}


def _reducer(points: DataFrame | dict[str, DataFrame], params: dict) -> tuple[str | None, int]:
    """What the reduced vectors of a parameter set depend on: the vector table and the number of components."""
    unknown = set(params) - GRID_OPTIONS
    if unknown:
        raise ValueError(f"options without an effect here: {sorted(unknown)}")
    if not isinstance(points, dict) and "embedding_model" in params:
        raise ValueError("embedding_model needs vector tables by name")
    return params["embedding_model"] if isinstance(points, dict) else None, params["n_components"]


def evaluate_density(points: DataFrame | dict[str, DataFrame], params: dict) -> DataFrame:
    """Score of one parameter set: reduce, find dense topics, silhouette on the original vectors.

    ``metric`` is that of the density step, ``embedding_model`` names one of several vector tables.
    """
    model, n_components = _reducer(points, params)
    points = points if model is None else points[model]
    reduced = pca_reduce(points, n_components).select("doc_id", "reduced")
    topics = density_topics(
        reduced, params["min_samples"], params["min_cluster_size"], metric=params.get("metric", "euclidean"), vector="reduced"
    )
    return silhouette_exact(points.join(topics, "doc_id"))


def grid_search(points: DataFrame | dict[str, DataFrame], grid: list[dict], threads: int = 4) -> DataFrame:
    """``params, score, best, error`` for every parameter set.

    ``points`` are the vectors, or several tables of them by the name of their encoder. Parameter sets run side by side as Spark jobs. One that fails keeps its row, without a score and with the error. The best
    is the first one whose score exceeds -1 and all scores before it.

    What parameter sets have in common is done once: the reduced vectors of a table, neighbours and links of the dense points for sets that
    differ in the least size of a topic only, and the distances between the vectors, from which all labellings are scored.
    """
    tables = points if isinstance(points, dict) else {None: points}

    def attempt(function, *args):
        try:
            return function(*args), None
        except Exception as error:  # noqa: BLE001 - a parameter set that cannot be fitted is skipped
            return None, error

    def shared(function, keys: list) -> dict:
        """``function`` of every different key, once, side by side."""
        different = list(dict.fromkeys(keys))
        return dict(zip(different, pool.map(lambda key: attempt(function, *key), different)))

    def use(pair):
        if pair[1] is not None:
            raise pair[1]
        return pair[0]

    def reduce_rows(model, n_components):
        return materialise(pca_reduce(tables[model], n_components).select("doc_id", "reduced"), "reduced")

    def members(model, n_components, metric, min_samples):
        rows = use(reduced[model, n_components])
        knn = knn_graph(rows, min_samples, metric, vector="reduced")
        return density_members(rows, knn, min_samples, metric=metric, vector="reduced")

    def label(model, n_components, metric, min_samples, min_cluster_size):
        found = density_labels(use(reduced[model, n_components]), use(linked[model, n_components, metric, min_samples]), min_cluster_size)
        return materialise(found, "topics")

    def score_all(model, *keys):
        """Silhouettes of several labellings of a table. Each names an id as often as the others do, so the first one decides how often a row comes."""
        labelled = tables[model].join(use(labels[keys[0]]).withColumnRenamed("topic", "_topic_0"), "doc_id")
        for i, key in enumerate(keys[1:], 1):
            labelled = labelled.join(use(labels[key]).dropDuplicates(["doc_id"]).withColumnRenamed("topic", f"_topic_{i}"), "doc_id")
        found = silhouette_many(labelled.withColumn("_labels", F.array(*[f"_topic_{i}" for i in range(len(keys))])), "_labels").collect()
        by_place = {r.pos: r.silhouette for r in found}
        return {key: by_place[i] for i, key in enumerate(keys)}

    def place(params: dict):
        model, n_components = _reducer(points, params)
        if model not in tables:
            raise KeyError(model)
        return model, n_components, params.get("metric", "euclidean"), params["min_samples"], params["min_cluster_size"]

    with ThreadPoolExecutor(threads) as pool:
        placed = [(params, *attempt(place, params)) for params in grid]
        valid = [(params, key) for params, key, error in placed if error is None]
        keys = [key for _, key in valid]
        reduced = shared(reduce_rows, [key[:2] for key in keys])
        linked = shared(members, [key[:4] for key in keys])
        labels = shared(label, keys)
        scored: dict = {}
        for model in dict.fromkeys(key[0] for key in keys):
            fine = [key for key in labels if key[0] == model and labels[key][1] is None]
            if fine:
                together, error = attempt(score_all, model, *fine)
                # One labelling that cannot be scored does not take the others with it.
                scored.update({key: (together[key], None) for key in fine} if error is None else {key: attempt(lambda k=key: score_all(model, k)[k]) for key in fine})
        scored.update({key: labels[key] for key in labels if labels[key][1] is not None})
    results = [(params, *((None, error) if error is not None else scored[key])) for params, key, error in placed]
    if grid and all(score is None for _, score, _ in results):
        raise RuntimeError("no parameter set could be evaluated") from results[0][2]
    best, best_score, rows = None, -1.0, []
    for params, score, error in results:
        if score is not None and score > best_score:
            best, best_score = params, score
        rows.append((params, score, f"{type(error).__name__}: {error}"[:500] if error else None))
    shown = [({k: str(v) for k, v in p.items()}, None if s is None else float(s), p is best, e) for p, s, e in rows]
    spark = (next(iter(points.values())) if isinstance(points, dict) else points).sparkSession
    return spark.createDataFrame(shown, "params map<string,string>, score double, best boolean, error string")
