"""Principal components from mergeable moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators.matrix import stack
from callweave.session import materialise


def moments(points: DataFrame, vector: str = "embedding", by: str | None = None) -> DataFrame:
    """Row ``i`` of the moment sums: ``i, n, total, products`` (number, sum of x_i, sums of x_i x_j).

    Tasks return one row per dimension, so the reduction spreads over the dimensions. Moments of
    several batches are merged by :func:`merge_moments`. ``by``, an integer column of few values such as a fold,
    gives the moments of each value, as ``part``, from the same pass.
    """

    def run(batches):
        held: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, part = stack(pdf["v"]), pdf["part"].to_numpy()
            for p in np.unique(part).tolist():
                rows = x[part == p]
                n, total, products = held.get(p, (0, 0.0, 0.0))
                held[p] = [n + len(rows), total + rows.sum(0), products + rows.T @ rows]
        for p, (n, total, products) in held.items():
            yield pd.DataFrame({"part": p, "i": np.arange(len(total)), "n": n, "total": total, "products": list(products)})

    part = F.coalesce(F.col(by).cast("int"), F.lit(-1)) if by else F.lit(0)
    slim = points.select(part.alias("part"), vx.scrub(F.col(vector)).alias("v"))
    found = merge_moments(slim.mapInPandas(run, "part int, i int, n long, total double, products array<double>"))
    return found if by else found.drop("part")


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Element-wise sum of moment tables."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    by = ["part", "i"] if "part" in merged.columns else ["i"]
    return merged.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"),
    )


def covariance(table: DataFrame) -> DataFrame:
    """Sample covariance ``i, j, value`` of a moment table."""
    means = table.select(F.col("i").alias("j"), (F.col("total") / F.col("n")).alias("mean_j"))
    cells = table.select("i", "n", (F.col("total") / F.col("n")).alias("mean_i"), F.posexplode("products").alias("j", "p"))
    value = (F.col("p") - F.col("n") * F.col("mean_i") * F.col("mean_j")) / (F.col("n") - 1)
    # One row per dimension.
    return cells.join(F.broadcast(means), "j").select("i", "j", value.alias("value"))


@dataclass(frozen=True)
class Projection:
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows."""
        return (x - self.mean) @ self.axes.T

    def restore(self, y: np.ndarray) -> np.ndarray:
        """The points in the space of the axes that have these coordinates."""
        return y @ self.axes + self.mean


@dataclass(frozen=True)
class Moments:
    """Number, sum and sum of products of rows: they add up, and the moments of a part can be taken off again."""

    n: float
    total: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.products - other.products)

    def projection(self, k: int) -> Projection:
        """Leading axes; each points where its largest entry is positive."""
        if self.n <= 0:
            raise ValueError("no rows to fit a projection on")
        mean = self.total / self.n
        cov = (self.products - self.n * np.outer(mean, mean)) / max(self.n - 1, 1)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        best = np.argsort(values)[::-1][:k]
        axes = vectors[:, best].T
        signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
        return Projection(mean, axes * signs[:, None], values[best])


def collect_moments(table: DataFrame) -> Moments:
    """A moment table on the driver: one row per dimension."""
    rows = table.orderBy("i").collect()
    if not rows:
        raise ValueError("no rows to fit a projection on")
    return Moments(rows[0].n, np.array([r.total for r in rows]), np.array([r.products for r in rows]))


def fit_projection(table: DataFrame, k: int) -> Projection:
    """Leading axes of a moment table."""
    return collect_moments(table).projection(k)


def holdout_projections(points: DataFrame, fold: str, k: int, vector: str = "embedding") -> dict[int, Projection]:
    """For each fold the projection of all other folds: the total moments less the fold's own, from one pass over the rows.

    The driver holds the total and one fold's moments at a time.
    """
    table = materialise(moments(points, vector, fold), "moments")
    whole = collect_moments(merge_moments(table.drop("part")))
    folds = [r.part for r in table.select("part").distinct().collect()]
    return {f: (whole - collect_moments(table.where(F.col("part") == f).drop("part"))).projection(k) for f in sorted(folds)}


def project(points: DataFrame, fitted: Projection, vector: str = "embedding", name: str = "reduced") -> DataFrame:
    @F.pandas_udf("array<double>")
    def reduce_rows(v: pd.Series) -> pd.Series:
        return pd.Series(list(fitted.apply(stack(v))))

    return points.withColumn(name, reduce_rows(vx.scrub(F.col(vector))))


def pca_reduce(points: DataFrame, k: int = 5, vector: str = "embedding", name: str = "reduced") -> DataFrame:
    return project(points, fit_projection(moments(points, vector), k), vector, name)


def reduce_for_plot(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """Plot position: the first two components."""
    flat = pca_reduce(points, 2, vector, "_xy")
    return flat.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_xy")
