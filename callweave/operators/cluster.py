"""Centres, assignment, k-means for many models at once, incremental updates, probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators.filters import hash_number, shuffle_key
from callweave.operators.matrix import group_sums, nearest, stack
from callweave.operators.reduce import Projection
from callweave.session import MODEL_BYTES, scratch_path

Centres = tuple[np.ndarray, np.ndarray]
# The projection under which the models that hold out a fold (or none) are fitted.
Lens = dict[int | None, Projection]


def collect_centres(centres: DataFrame, topic: str = "topic", vector: str = "centre") -> Centres:
    """A centre table as ids and matrix, ordered by id; refused when it exceeds the model bound."""
    rows = centres.select(topic, F.col(vector).cast("array<double>").alias("v")).orderBy(topic).toLocalIterator()
    ids, vectors, held = [], [], 0
    for row in rows:
        ids.append(row[0])
        vectors.append(row[1])
        held += 8 * len(row[1])
        if held > MODEL_BYTES:
            raise ValueError("centre table exceeds the size a model may have; assign it in parts")
    return np.array(ids), np.array(vectors, dtype=np.float64)


def assign_topics(points: DataFrame, centres: DataFrame | Centres, vector: str = "embedding") -> DataFrame:
    """Nearest centre and the distance to it for every row, without a shuffle."""
    ids, matrix = centres if isinstance(centres, tuple) else collect_centres(centres)

    @F.pandas_udf("topic int, distance double")
    def nearest_centre(v: pd.Series) -> pd.DataFrame:
        index, d = nearest(stack(v), matrix)
        return pd.DataFrame({"topic": ids[index].astype("int32"), "distance": d})

    return points.withColumn("_near", nearest_centre(vector)).select(
        *[c for c in points.columns if c not in ("topic", "distance")], "_near.topic", "_near.distance"
    )


def topic_probabilities(
    points: DataFrame, centres: DataFrame | Centres, key: str = "doc_id", vector: str = "embedding"
) -> DataFrame:
    """Soft membership: softmax over topics of the cosine between vector and centre."""
    ids, matrix = centres if isinstance(centres, tuple) else collect_centres(centres)
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<double>")
    def membership(v: pd.Series) -> pd.Series:
        x = stack(v)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        e = np.exp(x @ unit.T)
        return pd.Series(list(e / e.sum(1, keepdims=True)))

    topics = F.array(*[F.lit(int(t)) for t in ids])
    return points.select(key, F.explode(F.arrays_zip(topics.alias("topic"), membership(vector).alias("p"))).alias("m")).select(
        key, F.col("m.topic").alias("topic"), F.col("m.p").alias("probability")
    )


def mean_vectors(points: DataFrame, by: list[str], vector: str = "embedding", name: str = "centre") -> DataFrame:
    """Mean vector and size per group; partial means are formed before the shuffle."""
    return points.groupBy(*by).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias(name),
        F.count(F.lit(1)).alias("size"),
    )


@dataclass(frozen=True)
class Spec:
    """One k-means model: ``k`` centres fitted on all rows but those of fold ``holdout``."""

    k: int
    holdout: int | None = None


# Rounds in which candidates for starting centres are drawn; each draws this many times the wanted centres.
START_ROUNDS, OVERSAMPLING = 3, 2


def _chance(h: np.ndarray, salt: int) -> np.ndarray:
    """A repeatable number in (0, 1) from a content hash."""
    x = h.astype(np.int64).view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def _clean(vector: str, lens: Lens | None):
    """Vectors as the projection was fitted on: without null and non-finite components."""
    return vx.scrub(F.col(vector)) if lens else F.col(vector).cast("array<double>")


def _seen(x: np.ndarray, lens: Lens | None, holdout: int | None) -> np.ndarray:
    return lens[holdout].apply(x) if lens and len(x) else x


def _draw(
    hashed: DataFrame, found: dict[int | None, np.ndarray], count: dict[int | None, int], salt: int, lens: Lens | None = None
) -> dict[int | None, list[np.ndarray]]:
    """Draw vectors with a chance proportional to their squared distance to what was found, in one pass over all rows.

    Every vector gets an exponential waiting time with that rate, from its content hash; those with the shortest times
    are drawn. A task returns no more than ``count`` vectors a fold, and copies of a vector are drawn once.
    """
    slots = list(count)

    def run(batches):
        best: list[pd.DataFrame] = [pd.DataFrame() for _ in slots]
        for pdf in batches:
            if not len(pdf):
                continue
            x, h, part = stack(pdf["v"]), pdf["h"].to_numpy(), pdf["part"].to_numpy()
            wait = -np.log(_chance(h, salt))
            for i, slot in enumerate(slots):
                gap = nearest(_seen(x, lens, slot), found[slot])[1] ** 2 if slot in found else np.ones(len(x))
                use = np.flatnonzero((gap > 0) & ((part != slot) if slot is not None else True))
                rows = pd.DataFrame({"slot": i, "wait": wait[use] / gap[use], "h": h[use], "v": pdf["v"].iloc[use]})
                best[i] = pd.concat([best[i], rows.drop_duplicates("h")]).drop_duplicates("h").nsmallest(count[slot], ["wait", "h"])
        for rows in best:
            if len(rows):
                yield rows

    order = Window.partitionBy("slot").orderBy("wait", "h")
    drawn = (
        hashed.mapInPandas(run, "slot int, wait double, h long, v array<double>").dropDuplicates(["slot", "h"])
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(count.values())).collect()
    )
    out: dict[int | None, list[np.ndarray]] = {slot: [] for slot in slots}
    for r in sorted(drawn, key=lambda r: (r.slot, r.rank)):
        if r.rank <= count[slots[r.slot]]:
            out[slots[r.slot]].append(_seen(np.array([r.v]), lens, slots[r.slot])[0])
    return out


def spread_start(pool: np.ndarray, k: int, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
    """k-means++ on a pool: each next centre is drawn with a chance proportional to its weight and squared distance."""
    rng = np.random.default_rng(seed)
    weight = np.ones(len(pool)) if weight is None else weight
    chosen = [int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right"))]
    gap = ((pool - pool[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(pool)):
        total = (gap * weight).sum()
        if total <= 0:
            break
        chosen.append(int(np.searchsorted(np.cumsum(gap * weight), rng.random() * total, side="right")))
        gap = np.minimum(gap, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def initial_centres(
    points: DataFrame, specs: list[Spec], vector: str, fold: str | None, seed: int = 0, lens: Lens | None = None
) -> list[np.ndarray]:
    """Starting centres of every model, by k-means|| (Bahmani and others, 2012) over all rows outside its held-out fold.

    A few rounds draw candidates from all rows, far ones first; a counting pass weighs each by the rows it is nearest to; the
    weighted candidates, bounded by the size of the models, are reduced on the driver. All folds share the passes. Models of
    different size on the same rows share one draw: the smaller start is the head of the larger one.
    """
    part = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    hashed = points.select(part.alias("part"), F.xxhash64(vector).alias("h"), _clean(vector, lens).alias("v"))
    wanted = {h: max(s.k for s in specs if s.holdout == h) for h in dict.fromkeys(s.holdout for s in specs)}
    found: dict[int | None, np.ndarray] = {}
    for step in range(START_ROUNDS + 1):
        count = {h: OVERSAMPLING * k if step else 1 for h, k in wanted.items()}
        for h, rows in _draw(hashed, found, count, seed * 1000 + step + 1, lens).items():
            if rows:
                found[h] = np.vstack([found[h], *rows]) if h in found else np.array(rows)
    held = [h for h in wanted if h in found]
    if len(held) < len(wanted):
        raise ValueError("no rows to start from")
    counts = _partial_sums(points, [found[h] for h in held], [Spec(len(found[h]), h) for h in held], vector, fold, lens)
    weight = {h: np.zeros(len(found[h])) for h in held}
    for r in counts.groupBy("model", "cluster").agg(F.sum("n").alias("n")).collect():
        weight[held[r.model]][r.cluster] = r.n
    starts = {h: spread_start(found[h], wanted[h], seed, weight[h]) for h in held}
    return [starts[s.holdout][: s.k] for s in specs]


def _partial_sums(
    points: DataFrame, centres: list[np.ndarray], specs: list[Spec], vector: str, fold: str | None, lens: Lens | None = None
) -> DataFrame:
    """Per task, model and cluster: number of rows, vector sum and squared distance."""

    def run(batches):
        n = [np.zeros(len(c)) for c in centres]
        total = [np.zeros_like(c) for c in centres]
        cost = [np.zeros(len(c)) for c in centres]
        for pdf in batches:
            if not len(pdf):
                continue
            x = stack(pdf["v"])
            folds = pdf["fold"].to_numpy()
            views: dict[int | None, np.ndarray] = {}
            for m, c in enumerate(centres):
                held = specs[m].holdout
                if held not in views:
                    views[held] = _seen(x if held is None else x[folds != held], lens, held)
                rows = views[held]
                if not len(rows):
                    continue
                index, d = nearest(rows, c)
                n[m] += np.bincount(index, minlength=len(c))
                total[m] += group_sums(rows, index, len(c))
                cost[m] += np.bincount(index, weights=d * d, minlength=len(c))
        out = [
            (m, j, n[m][j], cost[m][j], total[m][j])
            for m in range(len(centres)) for j in range(len(centres[m])) if n[m][j] > 0
        ]
        if out:
            yield pd.DataFrame(out, columns=["model", "cluster", "n", "cost", "total"])

    folds = F.col(fold).cast("int") if fold else F.lit(-1)
    slim = points.select(_clean(vector, lens).alias("v"), F.coalesce(folds, F.lit(-1)).alias("fold"))
    return slim.mapInPandas(run, "model int, cluster int, n double, cost double, total array<double>")


def _passes(centres: list[np.ndarray]) -> list[range]:
    """Neighbouring models whose centres fit into the bound together; a larger model has passes of its own."""
    out, start, held = [], 0, 0
    for m, c in enumerate(centres):
        if held and held + c.nbytes > MODEL_BYTES:
            out.append(range(start, m))
            start, held = m, 0
        held += c.nbytes
    return [*out, range(start, len(centres))] if centres else []


def fit_many(
    points: DataFrame, specs: list[Spec], vector: str = "embedding", fold: str | None = None, max_iter: int = 20,
    tol: float = 1e-4, init: list[np.ndarray] | None = None, lens: Lens | None = None,
) -> tuple[list[np.ndarray], list[float]]:
    """k-means of several models (sizes, folds) in the same passes over the data.

    One pass per iteration serves all models, or as many as have room together: tasks return sums per cluster, which are reduced
    in the cluster; only the centres come to the driver. Also returns the inertia of
    each model, measured for the returned centres. With a ``lens`` every model is fitted on the coordinates that
    the projection for its held-out fold gives, and its centres are such coordinates.
    """
    centres = [c.copy() for c in (init or initial_centres(points, specs, vector, fold, lens=lens))]
    groups = _passes(centres)
    if len(groups) > 1:
        done = [fit_many(points, [specs[m] for m in g], vector, fold, max_iter, tol, [centres[m] for m in g], lens) for g in groups]
        return [c for part, _ in done for c in part], [x for _, part in done for x in part]
    active = True
    for step in range(max_iter + 1):
        reduced = (
            _partial_sums(points, centres, specs, vector, fold, lens)
            .groupBy("model", "cluster")
            .agg(
                F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
            )
            .collect()
        )
        inertia = [sum(r.cost for r in reduced if r.model == m) for m in range(len(specs))]
        if step == max_iter or not active:
            break
        moved = 0.0
        for r in reduced:
            new = np.array(r.total) / r.n
            moved = max(moved, float(((new - centres[r.model][r.cluster]) ** 2).sum()))
            centres[r.model][r.cluster] = new
        active = moved > tol * tol
    return centres, inertia


# Steps of a pass over the rows, and passes, of the fit by small steps.
BATCHES, EPOCHS = 20, 2


def fit_minibatch(
    points: DataFrame, specs: list[Spec], vector: str = "embedding", fold: str | None = None, batches: int = BATCHES, epochs: int = EPOCHS,
    key: str = "doc_id", seed: int = 0, init: list[np.ndarray] | None = None, lens: Lens | None = None,
) -> tuple[list[np.ndarray], list[float]]:
    """k-means of several models by small steps (Sculley, 2010): many updates of the centres in one pass over the data.

    A hash of the id cuts the rows into ``batches``, each stored in a folder of its own. A step reads one of them, sums its rows by nearest centre and
    moves every centre towards their mean, by the share that they have of all rows the centre has met so far: its learning rate falls as
    it meets more. The schedule is fixed, so the result is repeatable. Returns centres and inertia like :func:`fit_many`; all models share the steps.
    """
    spark = points.sparkSession
    kept = points.select(key, F.col(vector).alias(vector), *([fold] if fold else []))
    path = scratch_path(spark, "batches")
    cut = kept.withColumn("_batch", F.pmod(hash_number(shuffle_key(key, seed), 12), F.lit(batches)).cast("int"))
    cut.hint("rebalance", F.col("_batch")).write.partitionBy("_batch").parquet(path)
    stored = spark.read.schema(cut.schema).parquet(path)
    centres = [np.array(c, float) for c in (init or initial_centres(stored, specs, vector, fold, seed, lens))]
    met = [np.zeros(len(c)) for c in centres]
    groups = _passes(centres)
    for _ in range(epochs):
        for b in range(batches):
            batch = stored.where(F.col("_batch") == b)
            for g in groups:
                sums = (
                    _partial_sums(batch, [centres[m] for m in g], [specs[m] for m in g], vector, fold, lens).groupBy("model", "cluster")
                    .agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).collect()
                )
                for r in sums:
                    m = g[r.model]
                    met[m][r.cluster] += r.n
                    centres[m][r.cluster] += (np.array(r.total) - r.n * centres[m][r.cluster]) / met[m][r.cluster]
    return fit_many(stored, specs, vector, fold, max_iter=0, init=centres, lens=lens)


def label_many(
    points: DataFrame, centres: list[np.ndarray], vector: str = "embedding", name: str = "labels", specs: list[Spec] | None = None, lens: Lens | None = None
) -> DataFrame:
    """Array of nearest-centre numbers, one per model, for every row; with a ``lens`` under the projection of each model."""

    def labelled(some: range):
        @F.pandas_udf("array<int>")
        def label(v: pd.Series) -> pd.Series:
            x, views, out = stack(v), {}, []
            for m in some:
                held = specs[m].holdout if specs else None
                if held not in views:
                    views[held] = _seen(x, lens, held)
                out.append(nearest(views[held], centres[m])[0])
            return pd.Series(list(np.stack(out, 1).astype("int32")))

        return label(_clean(vector, lens))

    return points.withColumn(name, F.concat(*[labelled(g) for g in _passes(centres)]))


def kmeans_topics(points: DataFrame, k: int = 100, seed: int = 0, vector: str = "embedding") -> tuple[KMeansModel, DataFrame]:
    """Spark ML k-means with a fixed seed; topics are cluster numbers."""
    prepared = points.withColumn("_features", array_to_vector(vx.scrub(F.col(vector))))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="topic").fit(prepared)
    return model, model.transform(prepared).drop("_features")


def kmeans_fixed_init(points: DataFrame, init: DataFrame, steps: int, vector: str = "embedding") -> Centres:
    """Centres after ``steps`` passes from given ones; a centre without rows stays where it is."""
    ids, matrix = collect_centres(init)
    centres, _ = fit_many(points, [Spec(len(ids))], vector, max_iter=steps, tol=0.0, init=[matrix])
    return ids, centres[0]


def inertia_by_fold(points: DataFrame, models: list[np.ndarray], fold: str = "fold", vector: str = "embedding") -> DataFrame:
    """Sum of squared distances of the rows of each fold to the nearest centre of the model with that number, in one job."""

    @F.pandas_udf("double")
    def cost(v: pd.Series, number: pd.Series) -> pd.Series:
        x, out = stack(v), np.zeros(len(v))
        for f in number.unique():
            rows = (number == f).to_numpy()
            out[rows] = nearest(x[rows], models[f])[1] ** 2
        return pd.Series(out)

    return points.select(fold, cost(vector, fold).alias("cost")).groupBy(fold).agg(F.sum("cost").alias("inertia"))


def inertia(points: DataFrame, centres: DataFrame | Centres, vector: str = "embedding") -> DataFrame:
    """Sum of squared distances to the nearest centre."""
    near = assign_topics(points, centres, vector)
    return near.agg(F.sum(F.col("distance") * F.col("distance")).alias("inertia"), F.count(F.lit(1)).alias("n"))
