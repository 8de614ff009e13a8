"""All-pairs work in cells of bounded size.

Rows are hashed by id into blocks of about ``block_rows`` rows and every pair of blocks is one
group. A task holds two blocks at most, whatever the keys or labels look like, and returns one
reduced row per point instead of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
# A task that owns a block and streams the other rows past it in pieces of ``BLOCK_ROWS`` has room for so many times as many rows of its own.
OWN_PIECES = 8


def block_count(n: int, block_rows: int, parallelism: int) -> int:
    """Blocks for ``n`` rows: small enough for memory, enough of them to occupy the tasks."""
    blocks = math.ceil(n / block_rows)
    if n >= 1000:
        blocks = max(blocks, math.ceil(math.sqrt(2 * min(parallelism, 32))))
    return max(1, blocks)


def blocked_self(
    points: DataFrame,
    cell: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    schema: str,
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    group: str | None = None,
) -> DataFrame:
    """``cell(left, right, same)`` over every unordered pair of blocks; ``same`` marks the diagonal.

    With ``group`` (an integer column of few values) only rows of the same group are paired, and
    the rows passed to ``cell`` all have that value.
    """
    group_col = F.col(group) if group else F.lit(0)
    parallelism = points.sparkSession.sparkContext.defaultParallelism
    # One count per group value; the caller keeps those few.
    counts = {r.g: r.n for r in points.groupBy(group_col.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return points.sparkSession.createDataFrame([], schema)
    sizes = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, block_count(n, block_rows, parallelism))])
    spread = (
        points.withColumn("_group", group_col)
        .withColumn("_blocks", F.element_at(sizes, F.col("_group")))
        .withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .drop("_other", "_blocks")
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key_values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key_values
        if low == high:
            return cell(pdf, pdf, True)
        left = pdf[pdf["_block"] == low]
        right = pdf[pdf["_block"] == high]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        return cell(left, right, False)

    return spread.groupBy("_group", "_lo", "_hi").applyInPandas(run, schema)


def own_blocks(n: int, rows: int, parallelism: int) -> int:
    """Blocks of about ``rows`` rows for :func:`owned_blocks`, and enough to occupy the tasks."""
    return max(-(-n // rows), min(parallelism, 32) if n >= 1000 else 1)


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls, of lists of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of at most ``rows`` rows with equal integer ``keys``, from a stream sorted by them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            for at in range(a, b, rows):
                yield tuple(int(c[a]) for c in columns), batch.slice(at, min(rows, b - at))


def owned_blocks(
    points: DataFrame, start: Callable, step: Callable, finish: Callable, schema: str, key: str, blocks: dict[tuple[int, int], int],
    piece_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row against all rows of its group, by blocks whose owner streams the others past it.

    ``blocks`` gives the number of blocks for each (``part``, job); ``part`` is an integer column of ``points``, and a job is a number
    that the caller gives a meaning. Rows fall into blocks by the hash of ``key``. A task holds the rows of its own block and one piece of
    at most ``piece_rows`` others: ``state = start(part, job, own)``, then ``step(state, piece)`` for each piece, its own rows included,
    then the rows of ``finish(state)``. Only copies of rows are shuffled, one for each block, and no partial sum; the others come in no
    particular order.
    """
    spark = points.sparkSession
    jobs, before = sorted(blocks.items()), 0
    rows = []
    for (p, j), n in jobs:
        rows.append((p, j, n, before))
        before += n
    table = spark.createDataFrame(rows, "part int, _job int, _blocks int, _before int")
    copied = (
        points.join(F.broadcast(table), "part")  # one row a part and job
        .withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_side", (F.col("_own") != F.col("_block")).cast("int"))
        .withColumn("_task", F.col("_before") + F.col("_block")).drop("_own", "_blocks", "_before")
    )
    by = ["part", "_job", "_block"]

    def run(batches):
        held, own, state = None, [], None

        def opened():
            table = pa.Table.from_batches(own).combine_chunks()
            state = start(held[0], held[1], table)
            for at in range(0, table.num_rows, piece_rows):
                step(state, table.slice(at, piece_rows))
            return state

        for (*at, side), piece in _runs(batches, [*by, "_side"], piece_rows):
            if at != held:
                if held is not None and own:
                    yield finish(opened() if state is None else state)
                held, own, state = at, [], None
            if side == 0:
                own.append(piece)
            elif own:
                state = opened() if state is None else state
                step(state, pa.Table.from_batches([piece]))
        if held is not None and own:
            yield finish(opened() if state is None else state)

    # One block a task: by a hash some tasks would get several blocks and others none.
    return copied.repartitionById(max(before, 1), F.col("_task")).drop("_task").sortWithinPartitions(*by, "_side").mapInArrow(run, schema)
