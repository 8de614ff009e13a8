"""Stores: processed documents, embeddings, result rows, topic tables and models."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_documents(df: DataFrame, path: str, column: str = "text") -> None:
    """One document per line, written in parallel."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """Parquet at ``path`` when it is complete, otherwise the frame from ``build()`` written there."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def model_folder(model: str) -> str:
    return re.sub("/", "_", model)


def save_embeddings(df: DataFrame, root: str, model: str) -> None:
    """Vectors of one encoder in a folder named after it, with ``/`` turned into ``_``."""
    df.write.mode("overwrite").parquet(f"{root}/embeddings_{model_folder(model)}")


def load_embeddings(spark: SparkSession, root: str, model: str) -> DataFrame:
    path = f"{root}/embeddings_{model_folder(model)}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no embeddings at {path}")
    return spark.read.parquet(path)


def append_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add result rows to those already stored."""
    writer = df.write.mode("append")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def save_topic_info(df: DataFrame, path: str, run_column: str = "run") -> None:
    """Topic table per run (fold or number of topics); a rerun replaces only its own runs."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run_column)
        .parquet(path)
    )


def save_model(centres: DataFrame, terms: DataFrame, root: str, k: int) -> None:
    """A topic model as two tables under a path named after its number of topics."""
    centres.write.mode("overwrite").parquet(f"{root}/model_{k}/centres")
    terms.write.mode("overwrite").parquet(f"{root}/model_{k}/terms")


def load_model(spark: SparkSession, root: str, k: int) -> tuple[DataFrame, DataFrame]:
    path = f"{root}/model_{k}"
    if not path_exists(spark, f"{path}/terms/_SUCCESS"):
        raise FileNotFoundError(f"no model at {path}")
    return spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/terms")
