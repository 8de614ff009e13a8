"""Matrices in .npy files, against numpy."""

from __future__ import annotations

import os

import numpy as np
import pytest

from callweave.sources import matrices as mx


def read(df):
    rows = df.orderBy("row_id").collect()
    return [r.row_id for r in rows], np.array([r.embedding for r in rows])


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, dtype):
    x = (np.random.default_rng(0).normal(size=(1000, 12)) * 100).astype(dtype)
    path = str(tmp_path / "one.npy")
    np.save(path, x)
    df = mx.load_matrix(spark, path, split_bytes=12 * 8 * 64)
    assert df.rdd.getNumPartitions() >= 1000 // (12 * 8 * 64 // (12 * x.dtype.itemsize))
    ids, got = read(df)
    assert ids == list(range(1000)) and (got == x.astype(float)).all()
    assert df.where("row_id = 999").count() == 1


def test_folder_of_files(spark, tmp_path, monkeypatch):
    parts = [np.random.default_rng(i).normal(size=(n, 3)).astype("float32") for i, n in enumerate((5, 0, 7))]
    for i, x in enumerate(parts):
        np.save(str(tmp_path / f"b{i}.npy"), x)
    ids, got = read(mx.load_matrix(spark, f"file://{tmp_path}"))
    assert ids == list(range(12)) and (got == np.vstack(parts)).all()
    np.save(str(tmp_path / "c.npy"), np.zeros((2, 4)))
    with pytest.raises(Exception, match="differ in width"):
        mx.load_matrix(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("bad", [np.zeros(5), np.asfortranarray(np.ones((3, 2))), np.array([["a", "b"]])])
def test_other_arrays_are_refused(spark, tmp_path, bad):
    np.save(str(tmp_path / "x.npy"), bad)
    with pytest.raises(Exception, match="stored by rows"):
        mx.load_matrix(spark, str(tmp_path / "x.npy")).collect()


def test_a_cut_file_is_an_error(spark, tmp_path):
    path = str(tmp_path / "x.npy")
    np.save(path, np.ones((100, 4)))
    with open(path, "r+b") as file:
        file.truncate(os.path.getsize(path) - 8)
    with pytest.raises(Exception, match="ends before"):
        mx.load_matrix(spark, path).collect()


def test_written_in_the_order_of_the_key(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(250, 4)).astype("float32")
    order = np.random.default_rng(4).permutation(250)
    df = spark.createDataFrame([(int(i) * 7 - 300, [float(v) for v in x[i]]) for i in order], "doc_id long, embedding array<float>").repartition(5)
    path = str(tmp_path / "m")
    mx.save_matrix(df, path, part_rows=40)
    files = sorted(f for f in os.listdir(path) if f.endswith(".npy"))
    assert len(files) > 1 and "_SUCCESS" in os.listdir(path) and not [f for f in os.listdir(path) if f.startswith("_part")]
    assert (np.vstack([np.load(f"{path}/{f}") for f in files]) == x).all()
    ids, got = read(mx.load_matrix(spark, path))
    assert ids == list(range(250)) and (got == x).all()
    with pytest.raises(Exception, match="a vector is null"):
        mx.save_matrix(spark.createDataFrame([(1, None)], df.schema), str(tmp_path / "n"))
