"""Substring dedup: windows of words that repeat across documents, found by doubling lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Rolling, WordHash, mix, row_key, signed, slices, text_bytes
from callweave.session import fill_slots, materialise

# The shortest length looked at is the window halved until it is at most this.
SHORTEST = 30


def lengths(window: int) -> list[int]:
    """Window lengths from the shortest to the full one; each is about twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Hasher:
    """Two independent hashes for every window of a text."""

    def __init__(self):
        self.words = WordHash()
        self.one, self.two = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)

    def of(self, text: bytes | None) -> np.ndarray:
        return self.words.of(text.split()) if text else np.zeros(0, np.uint64)

    def anchors(self, hashes: np.ndarray, length: int, window: int) -> np.ndarray:
        """For each full window, the least hash among its windows of ``length``."""
        return _least(self.one.windows(hashes, length), window - length + 1)

    def pair(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return self.one.windows(hashes, length), self.two.windows(mix(hashes + np.uint64(1)), length)


def _alive(hasher: Hasher, hashes: np.ndarray, window: int, length: int | None, survivors) -> np.ndarray:
    """Which full windows still are candidates after the level ``length``."""
    n = max(0, len(hashes) - window + 1)
    if length is None:
        return np.ones(n, bool)
    if not n or survivors is None or not len(survivors):
        return np.zeros(n, bool)
    return np.isin(hasher.anchors(hashes, length, window), survivors)


def _level(window: int, length: int, below: int | None):
    """Anchors of the candidate windows at one length; at the first level also a key of each whole document."""

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches):
            ids, rows = batch.column("doc_id"), batch.column("r")
            known = batch.column("anchors") if below else None
            at, k1, k2 = [], [], []
            for i, text in enumerate(text_bytes(batch, "text")):
                h = hasher.of(text)
                if len(h) < window:
                    continue
                if below is None:
                    one, two = hasher.pair(h, len(h))
                    at.append(np.array([i]))
                    k1.append(one)
                    k2.append(two | np.uint64(1))
                alive = _alive(hasher, h, window, below, known[i].values.to_numpy().view(np.uint64) if below else None)
                keys = np.unique(hasher.anchors(h, length, window)[alive])
                at.append(np.full(len(keys), i))
                k1.append(keys)
                k2.append(np.zeros(len(keys), np.uint64))
            if at:
                index = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(index), rows.take(index), signed(np.concatenate(k1)), signed(np.concatenate(k2))], ["doc_id", "r", "k1", "k2"]
                )

    return run


def _windows(window: int, below: int | None):
    """Hashes of the candidate windows at the full length."""

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches):
            ids, rows, known = batch.column("doc_id"), batch.column("r"), batch.column("anchors")
            for i, text in enumerate(text_bytes(batch, "text")):
                h = hasher.of(text)
                alive = np.flatnonzero(_alive(hasher, h, window, below, known[i].values.to_numpy().view(np.uint64) if below else None))
                if len(alive):
                    one, two = hasher.pair(h, window)
                    index = pa.array(np.full(len(alive), i))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(index), rows.take(index), signed(one[alive]), signed(two[alive]), pa.array(alive.astype(np.int32))],
                        ["doc_id", "r", "h1", "h2", "start"],
                    )

    return run


def _cut(window: int):
    def run(batches):
        for batch in slices(batches):
            kept, total, removed = [], [], []
            for text, starts in zip(text_bytes(batch, "text"), batch.column("starts").to_pylist()):
                tokens = text.split() if text else []
                total.append(len(tokens))
                if starts and starts[0] >= 0 and len(tokens) >= window:
                    delta = np.zeros(len(tokens) + 1, np.int64)
                    at = np.unique(starts)
                    delta[at] += 1
                    delta[at + window] -= 1
                    gone = np.cumsum(delta)[:-1] > 0
                    removed.append(int(gone.sum()))
                    tokens = [t for t, g in zip(tokens, gone.tolist()) if not g]
                elif starts:
                    removed.append(len(tokens))
                    tokens = []
                else:
                    removed.append(0)
                kept.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return (
        rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").drop("last")
    )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, text) per row of ``docs``: the words left, joined by one space.

    A word goes when a window of ``window`` consecutive words covers it whose words also start in a document with a
    smaller id. Windows are judged on the input.

    Levels: a window can only repeat if its parts do. At each shorter length every full window is stood for by its anchor,
    the part with the least hash, which is the same wherever the window occurs; this thins the first, largest
    shuffle about thirteen-fold and loses nothing. Only windows whose anchor occurs in two documents reach the next,
    doubled length, and only those that reach the full length are compared as a whole (128 bits). Whole copies are told
    by one key and take no part beyond their first document. Each shuffle is a partial aggregation of minima or a join that
    adaptive execution can split.

    Null text has no words. Rows without an id neither lose words nor make others lose them. Repeated rows share an id, so
    they do not remove each other. A window of 30 words or fewer is one level by itself. Texts shorter than the window stay whole (their words joined by one space).
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("r", row_key("doc_id", "text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("r") == F.col("dr"))
    levels = lengths(window)
    copies = below = known = None
    for length in levels[:-1]:
        source = fill_slots(base, "doc_id") if known is None else base.join(known, same).select("doc_id", "text", "r", "anchors")
        rows = source.mapInArrow(_level(window, length, below), f"doc_id {kind}, r long, k1 long, k2 long").where("doc_id is not null")
        met = rows.join(_repeated(rows, ["k1", "k2"]), ["k1", "k2"])
        found = materialise(
            met.groupBy(F.col("doc_id").alias("d"), F.col("r").alias("dr")).agg(
                F.collect_set(F.when(F.col("k2") == 0, F.col("k1"))).alias("anchors"),
                F.max((F.col("k2") != 0) & (F.col("first") < F.col("doc_id"))).alias("copy"),
            ), "anchors",
        )
        if copies is None:
            copies = found.where("copy").select("d", "dr")
        known = found.where("not copy and size(anchors) > 0").select("d", "dr", "anchors")
        below = length
        if known.isEmpty():
            break
    if below is None:  # a window so short that its full length is the one level
        source = fill_slots(base.withColumn("anchors", F.lit(None).cast("array<long>")), "doc_id")
    else:
        source = base.join(known, same).select("doc_id", "text", "r", "anchors")
    # Filtered after the texts were shuffled, so that this exchange serves the last join too.
    candidates = source.mapInArrow(_windows(window, below), f"doc_id {kind}, r long, h1 long, h2 long, start int").where("doc_id is not null")
    later = candidates.join(_repeated(candidates, ["h1", "h2"]), ["h1", "h2"]).where("first < doc_id")
    starts = later.groupBy(F.col("doc_id").alias("d"), F.col("r").alias("dr")).agg(F.collect_set("start").alias("starts"))
    if copies is not None:
        starts = starts.unionByName(copies.select("d", "dr", F.array(F.lit(-1)).alias("starts")))
    return base.join(starts, same, "left").select("doc_id", "text", "starts").mapInArrow(
        _cut(window), f"doc_id {kind}, n_words long, n_removed long, text string"
    )
