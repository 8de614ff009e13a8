"""Vector code compression: whole-number codebooks by part, whose nearest entries are looked up through memoised grid cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import mix, slices
from callweave.operators.filters import first_rows
from callweave.session import checked_broadcast, fill_slots, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Remembered cells of a part; all are forgotten beyond that.
KEEP_CELLS = 8192
# Cells whose box distances are computed at once.
AT_ONCE = 1024


class Cells:
    """The nearest entry of one part's codebook, for vectors of whole numbers.

    A vector falls into a coarse grid cell. For each cell seen, the entries are remembered that may be nearest to a vector of
    its box: those whose least distance to the box is no more than the smallest of all entries' greatest distances. Only they are
    evaluated. The cells are half as wide as entries typically lie apart, rounded to a power of two.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = ((entries[:, None, :].astype(float) - entries[None, :, :]) ** 2).sum(2)
        apart = gaps[gaps > 0]
        nearest = np.sqrt(np.where(gaps > 0, gaps, np.inf).min(1)) if len(apart) else np.ones(1)
        self.shift = max(0, round(math.log2(max(1.0, float(np.median(nearest[np.isfinite(nearest)])) / 2))))
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.coords, self.near = np.zeros((0, self.entries.shape[1]), np.int64), np.zeros((0, len(self.entries)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which entries may be nearest to some vector in each cell."""
        out = []
        for at in range(0, len(cells), AT_ONCE):
            low = (cells[at : at + AT_ONCE] << self.shift)[:, None, :]
            high = low + (1 << self.shift) - 1
            least = (np.maximum(np.maximum(low - self.entries, self.entries - high), 0) ** 2).sum(2)
            most = (np.maximum(abs(self.entries - low), abs(self.entries - high)) ** 2).sum(2)
            out.append(least <= most.min(1, keepdims=True))
        return np.concatenate(out)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equally near ones, and its squared distance."""
        if len(self.slots) > KEEP_CELLS:
            self._forget()
        cells = rows >> self.shift
        key = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            key = mix(key + column.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        unique, first, which = np.unique(key, return_index=True, return_inverse=True)
        slot = np.fromiter((self.slots.get(k, -1) for k in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = len(self.coords) + np.arange(len(new))
            found = cells[first[new]]
            self.coords, self.near = np.concatenate([self.coords, found]), np.concatenate([self.near, self.candidates(found)])
            self.slots.update(zip(unique[new].tolist(), slot[new].tolist()))
        slot = slot[which]
        mask = self.near[slot]
        mask[(self.coords[slot] != cells).any(1)] = True  # another cell with the same hash
        row, entry = np.nonzero(mask)
        gap = ((rows[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(gap, starts)
        best = np.flatnonzero(gap == least[row])
        best = best[np.append(True, row[best][1:] != row[best][:-1])]
        return entry[best], least


class Codebooks:
    """Entries of all parts, as an array (part, entry, position) of whole numbers."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE):
        self.entries, self.scale = entries, scale

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Digest of all whole numbers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(values: list, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of vectors as rows of int64; refuses other lengths, and components whose squared distances might leave 64 bits."""
    if any(len(v) != width for v in values):
        raise ValueError(f"all vectors must have {width} components")
    x = np.floor(np.array(values, np.float64).reshape(-1, width) * scale)
    if len(x) and abs(x).max() > math.isqrt((1 << 62) // width) // 2:
        raise ValueError("a component is too large for 64-bit distances")
    return x.astype(np.int64)


def _kept(points: DataFrame, id_col: str, vec_col: str, others: dict[str, str]) -> DataFrame:
    """(vec_id, v, others) of the rows whose vector is there and has neither null nor non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return points.where(v.isNotNull() & ~odd).select(F.col(id_col).alias("vec_id"), v.alias("v"), *(F.col(c).alias(n) for n, c in others.items()))


def _matrix(batch: pa.RecordBatch, books: Codebooks) -> np.ndarray:
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * books.width and (column.value_lengths().to_numpy(zero_copy_only=False) == books.width).all():
        return whole_numbers(list(flat.reshape(-1, books.width)), books.scale, books.width)
    raise ValueError(f"all vectors must have {books.width} components")


def _sums(kept: DataFrame, books: Codebooks) -> np.ndarray:
    """Number and sum of the parts nearest to each entry, as whole numbers (part, entry, 1 + position); tasks return one row an entry."""
    parts, size, width = books.entries.shape

    def run(batches):
        cells = [Cells(e) for e in books.entries]
        total = np.zeros((parts, size, 1 + width), np.int64)
        for batch in slices(batches):
            rows = _matrix(batch, books).reshape(-1, parts, width)
            for p in range(parts if len(rows) else 0):
                x = np.ascontiguousarray(rows[:, p])
                entry, _ = cells[p].nearest(x)
                order = np.argsort(entry, kind="stable")
                used, start = np.unique(entry[order], return_index=True)
                total[p, used, 0] += np.diff(np.append(start, len(entry)))
                total[p, used, 1:] += np.add.reduceat(x[order], start, axis=0)
        p, e = np.nonzero(total[:, :, 0])
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p * size + e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["slot", "sums"])

    out = np.zeros((parts * size, 1 + width), object)
    told = (
        kept.select("v").mapInArrow(run, "slot int, sums array<long>").select("slot", F.posexplode("sums").alias("pos", "s"))
        .groupBy("slot", "pos").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    )
    for r in told.collect():  # entries times components at most
        out[r.slot, r.pos] = int(r.s)
    return out.reshape(parts, size, 1 + width)


def fit(
    points: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks:
    """Codebooks of ``parts`` equal consecutive parts of floor(scale * x), all in whole numbers.

    They start from the vectors of the ``entries`` smallest ids (equal ids by their vectors, rows without an id last) and take ``rounds``
    steps: every part goes to its nearest entry, the lowest of equally near ones, and each entry becomes the floor of the mean of its
    parts; unused entries stay. Each step is one pass over all rows whose vector is whole; only sums by entry are shuffled and
    collected. With no rows the codebooks are empty. Vectors must all have one length that the parts divide.
    """
    kept = _kept(points, id_col, vec_col, {})
    head = first_rows(kept, "vec_id", entries).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    if not head:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    if not head[0].v or len(head[0].v) % parts:
        raise ValueError(f"{len(head[0].v)} components cannot be cut into {parts} equal parts")
    start = whole_numbers([r.v for r in head], scale, len(head[0].v))
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).swapaxes(0, 1)), scale)
    for _ in range(rounds):
        sums = _sums(kept, books)
        n = sums[:, :, :1]
        mean = sums[:, :, 1:] // np.where(n > 0, n, 1)
        books = Codebooks(np.where(n > 0, mean, books.entries).astype(np.int64), scale)
    return books


def encode(
    points: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None
) -> DataFrame:
    """(vec_id, code, error) per row whose vector is whole, with ``label`` if a column is named; others are left out.

    The code has two hex digits a part, the error is the sum of the squared distances between parts and entries. Nothing is shuffled.
    """
    label = {"label": label_col} if label_col else {}
    kept = fill_slots(_kept(points, id_col, vec_col, label), "vec_id")
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        parts = books.entries.shape[0]
        cells = [Cells(e) for e in books.entries]
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            rows = _matrix(batch, books).reshape(batch.num_rows, parts, -1)
            found = [cells[p].nearest(np.ascontiguousarray(rows[:, p])) for p in range(parts)]
            code = ["".join(r) for r in digits[np.stack([e for e, _ in found], 1)].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(code, pa.string()), pa.array(sum(gap for _, gap in found), pa.int64()), *(batch.column(n) for n in label)],
                ["vec_id", "code", "error", *label],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(run, ", ".join(["vec_id " + kinds["vec_id"], "code string", "error long", *(f"label {kinds[n]}" for n in label)]))


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """``coded`` with a column ``approx``: the vector that the code stands for, at the middle of each whole number's interval."""
    sent = books.entries

    @F.pandas_udf("array<double>")
    def approx(codes: pd.Series) -> pd.Series:
        parts = np.arange(sent.shape[0])
        return codes.map(lambda c: None if c is None else ((sent[parts, [int(c[i : i + 2], 16) for i in range(0, len(c), 2)]].ravel() + 0.5) / books.scale).tolist())

    return coded.withColumn("approx", approx(code_col))


def compress(
    points: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row whose vector is neither null nor holds null or non-finite components.

    ``label_error`` sums the errors of all rows with an equal label, those without one together. The coded rows are written once, so
    the sums by label, formed before the shuffle, and the join do not encode again; the sums are broadcast if they are few. Repeated rows
    count each by itself, also among the first vectors.
    """
    books = fit(points, id_col, vec_col, parts, entries, rounds, scale)
    coded = materialise(encode(points, books, id_col, vec_col, label_col), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(checked_broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
