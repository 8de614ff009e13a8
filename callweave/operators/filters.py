"""Row filters, row caps, samples, ranks and folds."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclude_speaker(df: DataFrame, speaker: int = 1, column: str = "speakertypeid") -> DataFrame:
    """Drop one speaker type; rows without a speaker stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(speaker)))


def year_cap(df: DataFrame, last: int = 2025, column: str = "year") -> DataFrame:
    return df.where(F.col(column) <= last)


def year_range(df: DataFrame, first: int = 2010, last: int = 2022, column: str = "year") -> DataFrame:
    return df.where(F.col(column).between(first, last))


def min_length(df: DataFrame, longer_than: int = 30, column: str = "text") -> DataFrame:
    return df.where(F.length(column) > longer_than)


def drop_columns(df: DataFrame, *columns: str, strict: bool = False) -> DataFrame:
    """Drop columns; absent ones are an error only when ``strict``."""
    absent = [c for c in columns if c not in df.columns]
    if strict and absent:
        raise KeyError(f"columns not found: {absent}")
    return df.drop(*columns)


HISTOGRAM = 4096
# A range with no more rows than this is ordered directly.
DIRECT_ROWS = 50_000


def nth_smallest(keyed: DataFrame, number: str, order: str, n: int):
    """The ``n``-th smallest value of ``order`` (counting from one), or ``None`` with no more rows than that.

    ``number`` is an integer column that rises with ``order``. Its range is narrowed by histograms
    of a few thousand bars until the sought value lies among few rows; only those are ordered. Each
    step scans the key column of a shrinking range, and no task ever holds ``n`` rows per split.
    """
    low, high, total = keyed.agg(F.min(number), F.max(number), F.count(number)).first()
    if total <= n:
        return None
    left = n
    while True:
        width = -(-(high - low + 1) // HISTOGRAM)
        inside = keyed.where(F.col(number).between(low, high))
        bar = F.floor((F.col(number) - F.lit(low)) / F.lit(width)).cast("long") if width > 1 else F.col(number) - F.lit(low)
        bars = inside.groupBy(bar.alias("bar")).agg(
            F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")
        ).collect()
        for r in sorted(bars, key=lambda r: r.bar):
            if left <= r.n:
                low, high, rows = r.low, r.high, r.n
                break
            left -= r.n
        if rows <= DIRECT_ROWS or low == high:
            return inside.where(F.col(number).between(low, high)).select(order).orderBy(order).limit(left).agg(F.max(order)).first()[0]


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest value of a unique integer ``key``.

    The n-th key is found from the key column alone; the rows are then picked by a comparison that
    reaches the scan.
    """
    cut = nth_smallest(df.select(key), key, key, n)
    return df if cut is None else df.where(F.col(key) <= cut)


def shuffle_key(key: str, seed: int) -> Column:
    """Hash of seed and id: ordering by it is a repeatable random order. Rows without an id share one place."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def hash_number(order: Column, digits: int) -> Column:
    """The leading hex digits of a hash as an integer, in the same order."""
    return F.conv(F.substring(order, 1, digits), 16, 10).cast("long")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all of them if fewer) without replacement, the same on every run."""
    order = shuffle_key(key, seed)
    keys = df.select(order.alias("_order"), hash_number(order, 12).alias("_number"))
    cut = nth_smallest(keys, "_number", "_order", n)
    return df if cut is None else df.where(order <= cut)


def low_hash_bound(hashed: DataFrame, column: str, wanted: int) -> int | None:
    """A bound below which at least ``wanted`` distinct 64-bit hashes lie; ``None`` for no bound.

    Lets a caller pick the smallest hashes of a large table without ordering all of them.
    """
    n = hashed.count()
    share = 4.0 * wanted / max(n, 1)
    while share < 0.25:
        bound = int(-(2.0**63) + share * 2.0**64)
        if hashed.where(F.col(column) <= bound).select(column).distinct().count() >= wanted:
            return bound
        share *= 16
    return None


def global_rank(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense 0-based row rank without a one-task sort.

    ``bucket`` is an integer that rises with the order and takes at most some ten thousand values.
    Rows are counted per bucket, the running total over the small bucket table gives each bucket
    its offset, and rows are ranked within their bucket only.
    """
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        bucketed.withColumn("_within", within)
        .join(F.broadcast(offsets), F.col("_bucket").eqNullSafe(F.col("_of")))
        .withColumn(name, (F.col("_offset") + F.col("_within")).cast("long"))
        .drop("_bucket", "_within", "_offset", "_of")
    )


# Rows that a bucket of a ranking should hold, and the most buckets.
RANK_ROWS, RANK_BUCKETS = 50_000, 10_000


def assign_row_id(df: DataFrame, key: str = "doc_id", name: str = "row_id") -> DataFrame:
    """Consecutive row ids in the order of an integer key that is unique.

    The keys are cut into buckets at approximate quantiles, so a few far keys cannot crowd all others into one bucket. The
    ids are exact wherever the cuts lie. Rows without a key come first, at any size of the table; their order among
    themselves is open, and they are spread over as many buckets by a hash of the row.
    """
    parts = min(RANK_BUCKETS, -(-df.count() // RANK_ROWS))
    if parts <= 1:
        return global_rank(df, F.lit(0), [F.col(key)], name)
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    edges = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    cut = Bucketizer(splits=edges, inputCol="_key", outputCol="_cut", handleInvalid="keep").transform(keyed)
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    bucket = F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(*hashable), F.lit(parts))).otherwise(F.col("_cut")).cast("int")
    return global_rank(cut, bucket, [F.col(key)], name).drop("_key", "_cut")


def hash_rank(df: DataFrame, key: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Dense rank in the repeatable random order; hash prefixes make even buckets."""
    order = shuffle_key(key, seed)
    return global_rank(df, hash_number(order, 4), [order], name)


def kfold_split(df: DataFrame, key: str = "doc_id", n_splits: int = 10, seed: int = 42, exact: bool = True) -> DataFrame:
    """Fold number per row; fold sizes differ by one at most. Training rows are the other folds.

    ``exact=False`` takes the fold from the hash alone: no shuffle, sizes equal on average only.
    """
    if not exact:
        return df.withColumn("fold", F.pmod(hash_number(shuffle_key(key, seed), 12), F.lit(n_splits)).cast("int"))
    ranked = hash_rank(df, key, seed, "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(n_splits)).cast("int")).drop("_rank")


def drop_outliers_and_far(df: DataFrame, limit: float = 10.0) -> DataFrame:
    """Rows of real topics whose plot position lies strictly inside the square."""
    inside = (F.abs("x") < limit) & (F.abs("y") < limit)
    return df.where((F.col("topic") != -1) & inside)


def check_alignment(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys found on one side only, with the side that has them."""
    a, b = left.select(key), right.select(key)
    return (
        a.join(b, key, "left_anti").withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))
    )


def require_alignment(left: DataFrame, right: DataFrame, key: str = "doc_id") -> None:
    if not check_alignment(left, right, key).isEmpty():
        raise ValueError("documents and vectors do not match one to one")
