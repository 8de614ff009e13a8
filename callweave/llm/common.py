"""Words, hashes, grouped Arrow streams and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of lower-cased text: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The matches of ``WORD`` in UTF-8 ``text`` after A-Z are lower-cased; null has none."""
    return text.translate(_FOLD).split() if text else []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on pure ASCII, which is the quick case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes, or one longer row, which bounds the Python objects made from one of them."""

    def halves(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if piece.num_rows > 1 and piece.nbytes > size:
            middle = piece.num_rows // 2
            yield from halves(piece.slice(0, middle))
            yield from halves(piece.slice(middle))
        else:
            yield piece

    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield from halves(batch.slice(a, rows))


def bounded(arrays: Iterator[pa.Array]) -> Iterator[Iterator[pa.Array]]:
    """Of each array its slices; a function of one column makes an array as long out of what it finds for them."""
    for array in arrays:
        yield (batch.column(0) for batch in slices(iter([pa.RecordBatch.from_arrays([array], ["x"])])))


class WordHash(dict):
    """word -> 64-bit hash; remembers up to ``keep`` words."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a length, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def windows(self, hashes: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes)
        if n < length:
            return np.zeros(0, np.uint64)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return mix((sums[length:] - sums[: n - length + 1]) * self.down[: n - length + 1] + np.uint64(length))


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(doc_id, text) of ``docs``; with ``carry`` also its whole row, as one column that no name can clash with."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)


def with_text(found: DataFrame, columns: list[str], text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The carried rows with the new text; a column of text lengths follows it."""
    new = {text_col: F.col("text"), chars_col: F.char_length("text").cast("long")}
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def row_key(*columns: Column) -> Column:
    """64-bit key of a row's content, never null; joins on it also compare the id, so equal keys of other ids do no harm."""
    return F.xxhash64(*columns)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by integer ``keys`` into one table a group; holds one group and one batch."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held).combine_chunks()


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every group of ``keys``; the caller keeps the groups bounded."""

    def run(batches):
        for table in groups(batches, keys):
            out = fn(table)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the least node that can be reached.

    Alternates large and small stars: each node points its larger, then its smaller neighbours at the least one.
    The table is written after each round, and the rounds are logarithmic in the longest path.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        edges = materialise(small, label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
