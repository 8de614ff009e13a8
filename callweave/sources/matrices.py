"""Embedding matrices in ``.npy`` files, read by row ranges and written by parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from callweave.operators.filters import assign_row_id

# Bytes of a matrix that one task reads, and rows that it hands on at once.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 4096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or an address that Arrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Matrix:
    """What a file's header says."""

    path: str
    rows: int
    width: int
    dtype: str
    offset: int


def read_header(store: fs.FileSystem, path: str) -> Matrix:
    """Only the head of the file is read. A matrix by rows of real numbers is asked for."""
    with store.open_input_file(path) as file:
        version = npy.read_magic(file)
        shape, by_columns, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
        if len(shape) != 2 or by_columns or dtype.kind not in "fiu":
            raise ValueError(f"{path} is not a matrix of numbers stored by rows")
        return Matrix(path, shape[0], shape[1], dtype.str, file.tell())


@dataclass
class Rows(InputPartition):
    """A range of rows of one file; ``number`` is that of the first among all files."""

    matrix: Matrix
    first: int
    rows: int
    number: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def matrices(self) -> list[Matrix]:
        store, path = _store(self.path)
        if store.get_file_info(path).type != fs.FileType.Directory:
            return [read_header(store, path)]
        names = sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.path.endswith(".npy"))
        found = [read_header(store, name) for name in names]
        if len({m.width for m in found}) > 1:
            raise ValueError(f"the matrices in {self.path} differ in width")
        return found

    def partitions(self) -> list[Rows]:
        out, number = [], 0
        for m in self.matrices():
            step = max(1, self.split // max(1, m.width * np.dtype(m.dtype).itemsize))
            out += [Rows(m, a, min(step, m.rows - a), number + a) for a in range(0, m.rows, step)]
            number += m.rows
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        m, dtype = partition.matrix, np.dtype(partition.matrix.dtype)
        store, _ = _store(self.path)
        with store.open_input_file(m.path) as file:
            file.seek(m.offset + partition.first * m.width * dtype.itemsize)
            for a in range(0, partition.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.rows - a)
                data = file.read(n * m.width * dtype.itemsize)
                if len(data) < n * m.width * dtype.itemsize:
                    raise ValueError(f"{m.path} ends before its last row")
                values = pa.array(np.frombuffer(data, dtype).astype(np.float64))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * m.width)
                numbers = pa.array(np.arange(partition.number + a, partition.number + a + n))
                yield pa.RecordBatch.from_arrays([numbers, pa.ListArray.from_arrays(offsets, values)], ["row_id", "embedding"])


@dataclass
class Part(WriterCommitMessage):
    part: int
    name: str


class MatrixWriter(DataSourceArrowWriter):
    """One file a task; the names are those of the parts only after all of them are there."""

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], options.get("dtype", "float32")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        rows = [np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(self.dtype) for b in iterator if b.num_rows]
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        name = f"{path}/_part-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as file:
            if rows:
                matrix = np.concatenate(rows)
                npy.write_array_header_1_0(file, npy.header_data_from_array_1_0(matrix))
                file.write(np.ascontiguousarray(matrix).tobytes())
        return Part(TaskContext.get().partitionId(), name if rows else f"{name}-empty")

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        for m in messages:
            if not m.name.endswith("-empty"):
                store.move(m.name, f"{path}/part-{m.part:06d}.npy")
            else:
                store.delete_file(m.name.removesuffix("-empty"))
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.name.removesuffix("-empty"))


class MatrixSource(DataSource):
    """``spark.read.format("embedding_matrix")``: rows of one ``.npy`` file, or of all in a folder in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "embedding_matrix"

    def schema(self) -> str:
        return "row_id long, embedding array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options)


def load_matrix(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``row_id, embedding``: row numbers from 0 on over all files. Only headers are read to plan; a large file is read by many tasks."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("embedding_matrix").option("splitBytes", split_bytes).load(path)


def save_matrix(df: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", part_rows: int = 100_000, dtype: str = "float32") -> None:
    """Vectors in the order of an integer ``key`` as ``.npy`` parts of about ``part_rows`` rows, which is what a task holds.

    Read back, the row number of a vector is the rank of its key. Null vectors are an error, as a matrix has no place for them.
    """
    spark = df.sparkSession
    spark.dataSource.register(MatrixSource)
    ranked = assign_row_id(df.select(key, F.col(vector).cast("array<double>").alias("embedding")), key, "_row")
    parts = ranked.select(F.assert_true(F.col("embedding").isNotNull(), "a vector is null").alias("_ok"), "embedding", "_row").where("_ok is null")
    count = max(1, -(-df.count() // part_rows))
    cut = parts.withColumn("_part", F.floor(F.col("_row") / part_rows).cast("int"))
    placed = cut.repartitionByRange(count, "_part").sortWithinPartitions("_row").select("embedding")
    placed.write.format("embedding_matrix").option("dtype", dtype).mode("append").save(path)
