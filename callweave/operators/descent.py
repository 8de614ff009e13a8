"""Approximate neighbour graph for vectors of many dimensions: neighbours of neighbours are compared until few edges change.

After Dong, Moses, Li, "Efficient k-nearest neighbor graph construction for generic similarity measures", WWW 2011. The cost of a
round is the number of points times bounded samples; nothing depends on how well the space can be partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.matrix import distances, smallest, stack
from callweave.operators.neighbours import _shown, metric_points
from callweave.session import materialise

# Points that are compared with each other for a start, rounds of such starts, and rounds of comparing neighbours.
START_ROWS, STARTS, ROUNDS = 64, 2, 12
# Centres whose points a task holds at a time.
CENTRES = 128
EDGES = "id long, neighbour long, distance double"


def _blocks(points: DataFrame, k: int, metric: str, blocks: int, seed: int) -> DataFrame:
    """The nearest others of every point within a block of about ``START_ROWS`` points, dealt by a hash."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["id"].to_numpy(), stack(pdf["v"])
        d = _shown(distances(v, v), metric)
        np.fill_diagonal(d, np.inf)
        cols, near = smallest(d, ids, min(k, max(len(ids) - 1, 0)))
        rows = np.repeat(np.arange(len(ids)), cols.shape[1])
        return pd.DataFrame({"id": ids[rows], "neighbour": ids[cols.ravel()], "distance": near.ravel()})

    cut = points.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)))
    return cut.groupBy("block").applyInPandas(compare, EDGES)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each point; an edge that was there before is not new."""
    once = edges.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.min("new").alias("new"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_descent(
    df: DataFrame, k: int = 10, metric: str = "cosine", key: str = "doc_id", vector: str = "embedding", sample: int | None = None,
    rounds: int = ROUNDS, least_change: float = 0.002, seed: int = 0,
) -> DataFrame:
    """About the ``k`` nearest other points of every point: ``id, rank, neighbour, distance``, in the form of :func:`knn_graph`.

    Points start with the nearest of random blocks. In each round a point puts a sample of its neighbours, and of the points that have it as
    neighbour, ``sample`` of each and of either kind, new and old ones, side by side; pairs with a new one are compared, and each point keeps its ``k`` nearest. It ends when
    a round changes less than ``least_change`` of the edges. Distances are exact; which neighbours are found is not guaranteed. A point that
    everybody has as neighbour brings no more than its sample into a round. Draws are by hash, so the result is repeatable.
    """
    sample = sample or max(8, k)
    points = materialise(metric_points(df, metric, key, vector), "points")
    n = points.count()
    blocks = max(1, n // START_ROWS)
    first = _blocks(points, k, metric, blocks, seed)
    for s in range(1, STARTS if blocks > 1 else 1):
        first = first.unionByName(_blocks(points, k, metric, blocks, seed + s))
    graph = materialise(_best(first.withColumn("new", F.lit(True)).withColumn("fresh", F.lit(True)), k), "graph")

    def meet(ids: np.ndarray, v: np.ndarray, new: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _shown(distances(v, v), metric)
        np.fill_diagonal(d, np.inf)
        d[~(new[:, None] | new[None, :])] = np.inf
        d = np.round(d, 9)
        d[d > bound[:, None]] = np.inf
        cols, near = smallest(d, ids, min(k, max(len(ids) - 1, 0)))
        keep = np.isfinite(near.ravel())
        return np.repeat(ids, cols.shape[1])[keep], ids[cols.ravel()][keep], near.ravel()[keep]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """The points around each centre of a bucket; what many centres found about a pair is returned once."""
        centre, ids, new = pdf["centre"].to_numpy(), pdf["id"].to_numpy(), pdf["new"].to_numpy()
        order = np.lexsort((~new, ids, centre))
        centre, ids, new = centre[order], ids[order], new[order]
        once = np.r_[True, (centre[1:] != centre[:-1]) | (ids[1:] != ids[:-1])]
        order, centre, ids, new = order[once], centre[once], ids[once], new[once]
        v, bound = stack(pdf["v"])[order], pdf["bound"].to_numpy()[order]
        cuts = [0, *(np.flatnonzero(centre[1:] != centre[:-1]) + 1).tolist(), len(ids)]
        found = [meet(ids[a:b], v[a:b], new[a:b], bound[a:b]) for a, b in zip(cuts, cuts[1:])]
        out = pd.DataFrame(dict(zip(("id", "neighbour", "distance"), map(np.concatenate, zip(*found)))))
        return out.groupby(["id", "neighbour"], as_index=False)["distance"].min()

    buckets = max(1, n // CENTRES)
    for step in range(rounds):
        salt = F.xxhash64("id", "neighbour", F.lit(seed + step))
        some = Window.partitionBy("id", "new").orderBy(salt)
        ahead = graph.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= sample).select("id", "neighbour", "new")
        taken = materialise(ahead, "taken")
        back = taken.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "new")
        behind = back.withColumn("_r", F.row_number().over(Window.partitionBy("id", "new").orderBy(salt))).where(F.col("_r") <= sample).drop("_r")
        # Beyond this distance a point has no use for another neighbour.
        bound = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
        placed = points.join(bound, "id", "left").select(F.col("id").alias("neighbour"), "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        around = taken.unionByName(behind).join(placed, "neighbour")
        placed = around.select(F.col("id").alias("centre"), F.col("neighbour").alias("id"), "v", "new", "bound")
        met = placed.groupBy(F.pmod(F.xxhash64("centre", F.lit(seed)), F.lit(buckets)).alias("bucket")).applyInPandas(compare, EDGES)
        found = met.withColumn("new", F.lit(True)).withColumn("fresh", F.lit(True))
        # New edges that were looked at are old from now on.
        looked = taken.where("new").select("id", "neighbour", F.lit(True).alias("_seen"))
        held = graph.join(looked, ["id", "neighbour"], "left").select(
            "id", "neighbour", "distance", (F.col("new") & F.col("_seen").isNull()).alias("new"), F.lit(False).alias("fresh")
        )
        graph = materialise(_best(held.unionByName(found), k), "graph")
        if graph.where("fresh").count() <= least_change * n * k:
            break
    return graph.select("id", "rank", "neighbour", "distance")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact edges that were found; another point at the same distance counts as well."""
    furthest = exact.groupBy("id").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("k"))
    hits = found.join(furthest, "id").where(F.col("distance") <= F.col("limit")).groupBy("id", "k").agg(F.count(F.lit(1)).alias("n"))
    total = exact.count()
    return (hits.agg(F.sum(F.least("n", "k"))).first()[0] or 0) / total if total else 1.0
