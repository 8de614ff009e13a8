"""A fitted topic model: projection, centres and topic words, stored as tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators.matrix import nearest, stack
from callweave.operators.reduce import Projection
from callweave.sources.stores import path_exists

WORDS = "topic int, rank int, word string, score double"


@dataclass(frozen=True)
class TopicModel:
    """Centres (in the coordinates of the projection, if there is one) and the ranked words of the topics."""

    centres: np.ndarray
    projection: Projection | None
    words: DataFrame

    def transform(self, points: DataFrame, vector: str = "embedding") -> DataFrame:
        """``points`` with ``topic`` and ``distance`` (to the centre, in reduced coordinates); new documents as well as those of the fit."""
        centres, lens = self.centres, self.projection

        @F.pandas_udf("topic int, distance double")
        def place(v: pd.Series) -> pd.DataFrame:
            x = stack(v)
            index, d = nearest(lens.apply(x) if lens and len(x) else x, centres)
            return pd.DataFrame({"topic": index.astype("int32"), "distance": d})

        kept = [c for c in points.columns if c not in ("topic", "distance")]
        return points.withColumn("_place", place(vx.scrub(F.col(vector)))).select(*kept, "_place.topic", "_place.distance")

    def save(self, path: str) -> None:
        """Three small tables under ``path``; the words are written last and mark it complete."""
        spark = self.words.sparkSession
        rows = [("centre", i, c.tolist()) for i, c in enumerate(self.centres)]
        if self.projection:
            rows += [("mean", 0, self.projection.mean.tolist()), ("variances", 0, self.projection.variances.tolist())]
            rows += [("axis", i, a.tolist()) for i, a in enumerate(self.projection.axes)]
        spark.createDataFrame(rows, "part string, i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
        self.words.select("topic", "rank", "word", "score").write.mode("overwrite").parquet(f"{path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        if not path_exists(spark, f"{path}/words/_SUCCESS"):
            raise FileNotFoundError(f"no model at {path}")
        rows = spark.read.parquet(f"{path}/numbers").orderBy("part", "i").collect()  # centres and axes
        parts: dict[str, list] = {}
        for r in rows:
            parts.setdefault(r.part, []).append(r.v)
        lens = Projection(np.array(parts["mean"][0]), np.array(parts["axis"]), np.array(parts["variances"][0])) if "mean" in parts else None
        return cls(np.array(parts["centre"]), lens, spark.read.schema(WORDS).parquet(f"{path}/words"))
