"""Ward merge tree of topics, by rounds of mutual nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.cells import BLOCK_ROWS, blocked_self
from callweave.operators.matrix import distances, stack
from callweave.session import materialise


def _nearest(clusters: DataFrame, block_rows: int) -> DataFrame:
    """Nearest other cluster under Ward distance: ``cid, other, distance``."""

    def best(ids, others, d):
        by_id = np.argsort(others, kind="stable")
        at = np.round(d[:, by_id], 9).argmin(1)
        return pd.DataFrame({"cid": ids, "other": others[by_id][at], "distance": d[np.arange(len(ids)), by_id[at]]})

    def cell(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        na, nb = left["size"].to_numpy(float), right["size"].to_numpy(float)
        weight = 2.0 * na[:, None] * nb[None, :] / (na[:, None] + nb[None, :])
        d = np.sqrt(weight) * distances(stack(left["v"]), stack(right["v"]))
        if same:
            np.fill_diagonal(d, np.inf)
            return best(left["cid"].to_numpy(), right["cid"].to_numpy(), d)
        a, b = left["cid"].to_numpy(), right["cid"].to_numpy()
        return pd.concat([best(a, b, d), best(b, a, d.T)])

    found = blocked_self(clusters, cell, "cid long, other long, distance double", "cid", block_rows)
    first = F.min(F.struct(F.round("distance", 9).alias("r"), F.col("other"), F.col("distance"))).alias("m")
    return found.where("other <> cid").groupBy("cid").agg(first).select("cid", "m.other", "m.distance")


def topic_hierarchy(centres: DataFrame, block_rows: int = BLOCK_ROWS, cut: float = 0.7) -> DataFrame:
    """Merge tree ``step, left, right, distance, size, above_cut``; every topic starts with weight one.

    Ward linkage is reducible, so all mutually nearest clusters may merge in the same round and give
    the tree of the one-by-one procedure (Murtagh 1983). Merges are numbered by distance afterwards;
    leaves are 0 .. n-1 in topic order and step s creates cluster n + s. ``above_cut`` marks merges
    beyond ``cut`` times the greatest distance.
    """
    leaf = (F.row_number().over(Window.orderBy("topic")) - 1).cast("long")
    clusters = materialise(
        centres.select(leaf.alias("cid"), F.lit(1).cast("long").alias("size"), F.col("centre").cast("array<double>").alias("v")),
        "clusters",
    )
    n = alive = clusters.count()
    rounds = []
    while alive > 1:
        near = materialise(_nearest(clusters, block_rows), "near")
        back = near.select(F.col("cid").alias("other"), F.col("other").alias("cid"), F.lit(True).alias("mutual"))
        pairs = near.join(back, ["cid", "other"]).where("cid < other").select("cid", "other", "distance")
        a = clusters.select("cid", F.col("size").alias("na"), F.col("v").alias("va"))
        b = clusters.select(F.col("cid").alias("other"), F.col("size").alias("nb"), F.col("v").alias("vb"))
        merged = pairs.join(a, "cid").join(b, "other")
        size = F.col("na") + F.col("nb")
        mean = F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / size)
        base = (len(rounds) + 1) << 32
        # A temporary name no other cluster has: round base plus the smaller member.
        name = (F.lit(base) + F.col("cid") % F.lit(1 << 32)).cast("long")
        merged = materialise(
            merged.select(name.alias("parent"), "cid", "other", "distance", size.alias("size"), mean.alias("v")), "merged"
        )
        rounds.append(merged.select("parent", "cid", "other", "distance", "size"))
        gone = merged.select("cid").unionByName(merged.select(F.col("other").alias("cid")))
        rest = clusters.join(gone, "cid", "left_anti")
        clusters = materialise(
            rest.unionByName(merged.select(F.col("parent").alias("cid"), "size", "v")), "clusters"
        )
        alive = clusters.count()
    if not rounds:
        return centres.sparkSession.createDataFrame(
            [], "step int, left long, right long, distance double, size long, above_cut boolean"
        )
    merges = rounds[0]
    for more in rounds[1:]:
        merges = merges.unionByName(more)
    # One row per topic less one: a table of the size of the topic list.
    order = Window.orderBy(F.round("distance", 9), "size", "parent")
    numbered = materialise(merges.withColumn("step", F.row_number().over(order) - 1), "tree")
    number = numbered.select(F.col("parent").alias("cid"), (F.col("step") + n).cast("long").alias("id"))
    left = number.select(F.col("cid"), F.col("id").alias("l"))
    right = number.select(F.col("cid").alias("other"), F.col("id").alias("r"))
    named = numbered.join(left, "cid", "left").join(right, "other", "left")
    l, r = F.coalesce("l", "cid"), F.coalesce("r", "other")
    top = numbered.agg(F.max("distance")).scalar()
    return named.select(
        "step", F.least(l, r).alias("left"), F.greatest(l, r).alias("right"), "distance", "size",
        (F.col("distance") > top * cut).alias("above_cut"),
    )
