from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from callweave.operators import filters as fl

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.lists(st.integers(-(10**9), 10**9), unique=True, min_size=1, max_size=60))
def test_row_ids_are_consecutive(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.row_id for r in fl.assign_row_id(df).collect()}
    assert got == {v: n for n, v in enumerate(sorted(ids))}


def test_a_far_key_does_not_crowd_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fl, "RANK_ROWS", 100)
    sizes = []
    whole = fl.global_rank
    monkeypatch.setattr(fl, "global_rank", lambda df, bucket, *a: (sizes.extend(r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()), whole(df, bucket, *a))[1])
    ids = [*range(5000), 10**17]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert {r.doc_id: r.row_id for r in fl.assign_row_id(df).collect()} == {v: n for n, v in enumerate(ids)}
    assert max(sizes) < 400 and sum(sizes) == len(ids)


@QUICK
@given(st.integers(1, 80), st.integers(2, 7), st.integers(0, 5))
def test_folds_partition_the_ids(spark, n, splits, seed):
    got = fl.kfold_split(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", splits, seed).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = [sum(r.fold == f for r in got) for f in range(splits)]
    assert max(sizes) - min(sizes) <= 1
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    assert {r.doc_id: r.fold for r in got} == {i: rank % splits for rank, i in enumerate(order)}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    one = {r.id for r in fl.sample_rows(df, "id", 100).collect()}
    two = {r.id for r in fl.sample_rows(df.repartition(13), "id", 100).collect()}
    assert len(one) == 100 and one == two
    assert {r.id for r in fl.sample_rows(df, "id", 100, seed=1).collect()} != one
    assert fl.sample_rows(df, "id", 5000).count() == 1000


def test_row_cap_does_not_sort_the_text(spark):
    df = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 10))
    capped = fl.first_rows(df, "id", 7)
    assert sorted(r.id for r in capped.collect()) == list(range(7))


def test_alignment(spark):
    a, b = spark.range(5).withColumnRenamed("id", "doc_id"), spark.range(1, 6).withColumnRenamed("id", "doc_id")
    assert {tuple(r) for r in fl.check_alignment(a, b).collect()} == {(0, "left"), (5, "right")}
    fl.require_alignment(a, a)


def test_empty_input(spark):
    empty = spark.range(0).withColumnRenamed("id", "doc_id")
    assert fl.assign_row_id(empty).count() == 0
    assert fl.kfold_split(empty).count() == 0


@QUICK
@given(st.lists(st.integers(-(10**12), 10**12), unique=True, min_size=1, max_size=80), st.integers(1, 90))
def test_nth_smallest_by_refinement(spark, ids, n):
    was = fl.DIRECT_ROWS, fl.HISTOGRAM
    fl.DIRECT_ROWS, fl.HISTOGRAM = 3, 7
    try:
        cut = fl.nth_smallest(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id", "doc_id", n)
    finally:
        fl.DIRECT_ROWS, fl.HISTOGRAM = was
    assert cut == (sorted(ids)[n - 1] if n < len(ids) else None)


def test_low_hash_bound(spark):
    hashed = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    bound = fl.low_hash_bound(hashed, "h", 100)
    kept = hashed.where(F.col("h") <= bound).count()
    assert 100 <= kept < 2000
    assert fl.low_hash_bound(hashed.limit(50), "h", 100) is None
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("h"))
    assert fl.low_hash_bound(copies, "h", 10) is None


def test_hash_folds_need_no_ranking(spark):
    got = fl.kfold_split(spark.range(3000).withColumnRenamed("id", "doc_id"), exact=False)
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 3000 and min(sizes) > 200


@pytest.mark.parametrize("rows", [5, 50_000])
def test_rows_without_a_key_are_ranked_at_any_size(spark, monkeypatch, rows):
    monkeypatch.setattr(fl, "RANK_ROWS", rows)
    df = spark.createDataFrame([(None if i % 4 == 0 else i * 3, {"a": i}) for i in range(41)], "doc_id long, extra map<string,int>")
    got = fl.assign_row_id(df).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(41))
    assert [r.doc_id for r in got] == [None] * 11 + sorted(i * 3 for i in range(41) if i % 4)
    assert sorted(r.extra["a"] for r in got) == list(range(41))


def test_rows_without_a_key_get_a_fold(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else i,) for i in range(40)], "doc_id long")
    folds = fl.kfold_split(df, n_splits=4).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {f: 10 for f in range(4)}
    assert fl.sample_rows(df, "doc_id", 100).count() == 40
