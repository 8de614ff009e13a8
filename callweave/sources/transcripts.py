"""Transcript scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.dates import parse_timestamp, publish_month, publish_year, year_quarter

# Bytes of a row group of stored transcripts, before compression.
ROW_GROUP_BYTES = 8 << 20

TRANSCRIPT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("speakertypeid", T.IntegerType()),
        T.StructField("componenttext", T.StringType()),
        T.StructField("componenttextpreview", T.StringType()),
        T.StructField("transcriptcreationdate_utc", T.StringType()),
    ]
)


def scan_transcripts(
    spark: SparkSession, path: str | list[str], fmt: str = "csv", schema: T.StructType = TRANSCRIPT_SCHEMA, line_breaks: bool = True
) -> DataFrame:
    """Scan the columns of ``schema`` with its types; nothing is inferred from the data.

    CSV columns are found by the names in the header, wherever they stand; other columns are left out, and a missing one is an
    error. All files of a scan have the same header; one that differs stops it. Quoted CSV fields may hold line breaks, so one CSV
    file is one task. Files without line breaks in fields can be split: pass ``line_breaks=False``. Other large collections
    should come as many files, or be turned once into parquet with :func:`ingest`.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    options = {"header": True, "multiLine": line_breaks, "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    known = {f.name: f for f in schema.fields}
    header = spark.read.options(**options).csv(path).columns
    missing = [c for c in known if c not in header]
    if missing:
        raise ValueError(f"columns not found in the header: {missing}")
    in_file = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.schema(in_file).options(**options).csv(path).select(*known)


def with_publish_columns(df: DataFrame, date_column: str, strict: bool = True) -> DataFrame:
    """Parsed date, year, month and year-quarter label of the publication date."""
    ts = F.col("published_at")
    return (
        df.withColumn("published_at", parse_timestamp(F.col(date_column).cast("string"), strict))
        .withColumn("publish_year", publish_year(ts))
        .withColumn("publish_month", publish_month(ts))
        .withColumn("publish_yearq", year_quarter(ts))
    )


def ingest(df: DataFrame, path: str, partition: str = "publish_yearq") -> None:
    """Store transcripts as parquet by year-quarter, so later filters skip whole folders.

    The rebalance hint sizes the output: adaptive execution splits a quarter that holds a third of
    the rows over many tasks and puts small quarters together. Files are made of small row groups, so that
    all cores share the scan of one quarter.
    """
    writer = df.hint("rebalance", F.col(partition)).write.option("parquet.block.size", ROW_GROUP_BYTES)
    writer.mode("overwrite").partitionBy(partition).parquet(path)


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks one after another, matched by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


def scan_word_list(df: DataFrame, column: str) -> DataFrame:
    """A one-column word list, trimmed, lower-cased and without repeats."""
    return df.select(F.lower(F.trim(F.col(column))).alias("word")).where("word <> ''").distinct()


def derived_transcripts(doc: DataFrame) -> DataFrame:
    """Transcript-shaped view of a ``documents`` table: speaker, date, segments and topic."""
    i = F.col("doc_id")
    mark = "|||"
    return doc.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(i % 17 == 0, None).otherwise(i % 5).cast("int").alias("speakertypeid"),
        F.date_add(F.lit("2009-01-01").cast("date"), (i * 37 % 6000).cast("int")).cast("timestamp_ntz").alias("created_at"),
        F.concat(
            F.lit("Welcome" + mark),
            F.when(i % 10 == 0, "").otherwise("Operator" + mark),
            F.replace("text", F.lit("\n"), F.lit(mark)),
            F.when(i % 7 == 0, mark + "These forward-looking statements involve risks").otherwise(""),
        ).alias("body"),
        F.when(i % 13 == 0, -1).otherwise(F.substring("source", 4, 9).cast("int")).cast("int").alias("topic"),
    )
