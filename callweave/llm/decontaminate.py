"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bounded, keyed, mix, slices, text_bytes, words
from callweave.session import fill_slots, materialise

# Item text handled by one pass over the documents; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20
# Items with more words are cut into pieces, which share the words of the windows that cross a cut.
PIECE_WORDS = 50_000
# Words matched at once in a task.
CHUNK_WORDS = 400_000

OUT = "doc_id {id}, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:int,end:int>>"


class Windows:
    """The item windows of one block: words as numbers, shingles as keys, and an index of the prefix shingles."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int, shingle: int, threshold: float):
        self.size, self.shingle, self.threshold = size, shingle, threshold
        self.vocab: dict[bytes, int] = {}
        known: dict[bytes, int] = {}
        self.owners: list[set[str]] = []
        rows = []
        for item, text in items:
            tokens = words(text)
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens], np.int64)
            n = min(size, len(ids))
            for start in range(len(ids) - n + 1 if n else 0):
                window = ids[start : start + n]
                at = known.setdefault(window.tobytes(), len(self.owners))
                if at == len(self.owners):
                    self.owners.append(set())
                    rows.append(window)
                if item is not None:
                    self.owners[at].add(item)
        self.length = np.array([len(w) for w in rows], np.int64)
        self.words = np.zeros((len(rows), size), np.int64)
        for i, w in enumerate(rows):
            self.words[i, : len(w)] = w
        # Shingle keys of the windows: one row for each shingle of a window.
        window, offset, key = [], [], []
        for width in np.unique(np.minimum(self.length, shingle)):
            for o in range(size - int(width) + 1):
                has = np.flatnonzero((np.minimum(self.length, shingle) == width) & (self.length >= o + width))
                window.append(has)
                offset.append(np.full(len(has), o))
                key.append(self.keys(self.words[has, o : o + width], int(width)))
        self.window, self.offset, self.key = (
            np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (window, offset, key)
        )
        self.widths = sorted({int(x) for x in np.minimum(self.length, shingle)})
        self.all_keys = np.unique(self.key)

    @staticmethod
    def keys(columns: np.ndarray, width: int) -> np.ndarray:
        """Hashes of shingles; those that collide cost a comparison of words and nothing else."""
        out = np.full(len(columns), width, np.uint64)
        for i in range(width):
            out = mix(out + columns[:, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64)

    def need(self, shingles: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil(shingles * self.threshold - 1e-9)).astype(np.int64)

    def index(self, frequency: dict[int, int]) -> None:
        """Keep, of each window, the prefix: its rarest n - need + 1 shingles."""
        count = np.array([frequency.get(int(k), 0) for k in self.all_keys], np.int64)
        rarity = count[np.searchsorted(self.all_keys, self.key)]
        order = np.lexsort((self.offset, self.key, rarity, self.window))
        w = self.window[order]
        first = np.r_[0, np.flatnonzero(w[1:] != w[:-1]) + 1] if len(w) else np.zeros(0, np.int64)
        per = np.diff(np.r_[first, len(w)])
        rank = np.arange(len(w)) - np.repeat(first, per)
        keep = order[rank < np.repeat(per - self.need(per) + 1, per)]
        keep = keep[np.argsort(self.key[keep], kind="stable")]
        self.key, self.window, self.offset = self.key[keep], self.window[keep], self.offset[keep]

    def numbered(self, tokens: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))

    def shingles(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, key) of the document shingles whose words all occur in items."""
        for width in self.widths:
            if len(ids) < width:
                continue
            known = np.ones(len(ids) - width + 1, bool)
            for i in range(width):
                known &= ids[i : len(ids) - width + 1 + i] > 0
            at = np.flatnonzero(known)
            yield at, self.keys(np.stack([ids[at + i] for i in range(width)], 1), width)

    def occurrences(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of the occurrences. ``first`` and ``end``: bounds of the document each word is in."""
        starts, found = [], []
        for at, key in self.shingles(ids):
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            per = high - low
            hit = np.flatnonzero(per)
            for a in range(0, len(hit), 50_000):
                part = hit[a : a + 50_000]
                n = per[part]
                entry = np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                position, window = np.repeat(at[part], n), self.window[entry]
                start = position - self.offset[entry]
                length = self.length[window]
                fits = (start >= first[position]) & (start + length <= end[position])
                start, window, length = start[fits], window[fits], length[fits]
                for b in range(0, len(start), 100_000):
                    s, w, n_words = start[b : b + 100_000], window[b : b + 100_000], length[b : b + 100_000]
                    cell = np.minimum(s[:, None] + np.arange(self.size), len(ids) - 1)
                    same = (ids[cell] == self.words[w]) | (np.arange(self.size) >= n_words[:, None])
                    width = np.minimum(n_words, self.shingle)
                    equal = np.zeros(len(s), np.int64)
                    for o in range(self.size):
                        inside = o + width <= n_words
                        whole = inside.copy()
                        for i in range(self.shingle):
                            if o + i < self.size:
                                whole &= same[:, o + i] | (i >= width)
                        equal += whole
                    good = equal >= self.need(n_words - width + 1)
                    starts.append(s[good])
                    found.append(w[good])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, found))


def _chunks(texts: list[bytes | None], windows: Windows):
    """Documents side by side, a zero after each: (first row, numbered words, starts, lengths)."""
    begin, size, tokens = 0, 0, []
    for i, text in enumerate(texts):
        tokens.append(np.append(windows.numbered(words(text)), 0))
        size += len(tokens[-1])
        if size >= CHUNK_WORDS or i == len(texts) - 1:
            lengths = np.array([len(t) - 1 for t in tokens], np.int64)
            yield begin, np.concatenate(tokens), np.cumsum(lengths + 1) - lengths - 1, lengths
            begin, size, tokens = i + 1, 0, []


def _count(windows):
    def run(batches):
        w = windows.value
        total = np.zeros(len(w.all_keys), np.int64)
        for batch in slices(batches):
            for _, ids, starts, _ in _chunks(text_bytes(batch, "text"), w):
                for at, key in w.shingles(ids):
                    slot = np.minimum(np.searchsorted(w.all_keys, key), len(w.all_keys) - 1)
                    ok = w.all_keys[slot] == key
                    doc = np.searchsorted(starts, at[ok], "right")
                    pairs = np.unique(doc * len(w.all_keys) + slot[ok])
                    total += np.bincount(pairs % len(w.all_keys), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(w.all_keys[some]), pa.array(total[some])], ["key", "n"])

    return run


def _match(windows, last: bool):
    def run(batches):
        w = windows.value
        for batch in slices(batches):
            texts = text_bytes(batch, "text")
            masks, items, n_words = [], [], []
            before = batch.column("hit").to_pylist() if "hit" in batch.schema.names else [None] * len(texts)
            owned = batch.column("items").to_pylist() if "items" in batch.schema.names else [None] * len(texts)
            for begin, ids, first, lengths in _chunks(texts, w):
                doc = np.repeat(np.arange(len(lengths)), lengths + 1)
                start, window = w.occurrences(ids, first[doc], (first + lengths)[doc])
                delta = np.zeros(len(ids) + 1, np.int64)
                np.add.at(delta, start, 1)
                np.add.at(delta, start + w.length[window], -1)
                covered = np.cumsum(delta)[:-1] > 0
                mine: dict[int, set[str]] = {}
                for d, x in np.unique(np.stack([doc[start], window], 1), axis=0).tolist() if len(start) else ():
                    mine.setdefault(d, set()).update(w.owners[x])
                for d in range(len(lengths)):
                    mask = covered[first[d] : first[d] + lengths[d]]
                    if before[begin + d]:
                        mask = mask | np.unpackbits(np.frombuffer(before[begin + d], np.uint8), count=len(mask)).astype(bool)
                    masks.append(mask)
                    n_words.append(len(mask))
                    items.append(sorted(mine.get(d, set()) | set(owned[begin + d] or ())))
            out = [batch.column("doc_id")]
            row = ["row"] if "row" in batch.schema.names else []
            if last:
                spans = []
                for mask in masks:
                    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
                    spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                out += [
                    pa.array(n_words, pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ]
                names = ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans"]
            else:
                out += [
                    batch.column("text"), pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()),
                    pa.array(items, pa.list_(pa.string())),
                ]
                names = ["doc_id", "text", "hit", "items"]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(c) for c in row)], [*names, *row])

    return run


def _pieces(size: int):
    """Items as texts of at most ``PIECE_WORDS`` words that hold the same windows."""

    def run(batches):
        step = max(1, PIECE_WORDS - size + 1)
        for batch in slices(batches):
            at, texts = [], []
            for i, text in enumerate(text_bytes(batch, "text")):
                tokens = words(text)
                for start in range(0, max(1, len(tokens) - size + 1), step):
                    at.append(i)
                    texts.append(b" ".join(tokens[start : start + step + size - 1]))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], ["item", "text"])

    return run


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = 10, shingle: int = 3, threshold: float = 1.0, block_bytes: int = BLOCK_BYTES,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, spans) per row of ``docs``.

    A window is ``size`` consecutive words of an item, or all words of a shorter one. Its set is the shingles of
    ``shingle`` words with their places. Shingles are ordered by the number of documents they occur in, counted over all
    documents; with n shingles of which ``threshold`` must be found, only the n - need + 1 rarest are looked up. A hit
    fixes the place of the window, which must lie inside the document (length and position bounds), and is verified word
    by word; at the threshold of 1 the words are equal. ``spans`` are the covered runs of words, ``item_ids`` the items with an
    occurring window.

    The benchmark is taken in blocks of bounded bytes; each block is one counting and one matching pass over the documents,
    so its size bounds what is broadcast, and documents are never shuffled. A long item is cut into pieces that hold the same windows.
    Null text has no words. Items without an id are searched for like all others: their words are hit, but they have no name to show among
    ``item_ids`` and are not in ``n_items``. Repeated items count once by id; repeated documents are
    judged row by row. ``carry`` adds the whole input row as a column ``row``. Without items every document is clean.
    """
    base = fill_slots(keyed(docs, id_col, text_col, carry), "doc_id")
    sc = docs.sparkSession.sparkContext
    kind = base.schema["doc_id"].dataType.simpleString()
    current = base
    for windows, last in _blocks(base.select("text"), items, item_id, item_text, size, shingle, threshold, block_bytes):
        schema = OUT.format(id=kind) if last else f"doc_id {kind}, text string, hit binary, items array<string>"
        schema += f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
        current = current.mapInArrow(_match(sc.broadcast(windows), last), schema)
    return current


def _blocks(
    texts: DataFrame, items: DataFrame, item_id: str, item_text: str, size: int, shingle: int, threshold: float, block_bytes: int
) -> Iterator[tuple[Windows, bool]]:
    """The windows of each block of the benchmark, indexed by their shingles' frequency in ``texts``, and whether it is the last."""
    known = materialise(
        items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
        .where("text is not null").mapInArrow(_pieces(size), "item string, text string").distinct(), "items",
    )
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        windows = Windows([(r.item, r.text.encode()) for r in rows], size, shingle, threshold)
        counted = texts.mapInArrow(_count(texts.sparkSession.sparkContext.broadcast(windows)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        windows.index({r.key: r.n for r in counted.collect()})
        yield windows, b == blocks - 1


def uncontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, shingle: int = 3,
    threshold: float = 1.0, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs; only the text passes through Python.

    Rows that a block of the benchmark hits do not meet the next block.
    """
    current = docs
    texts = fill_slots(docs.select(F.col(text_col).alias("text")), "text")
    for windows, _ in _blocks(texts, items, item_id, item_text, size, shingle, threshold, block_bytes):
        current = current.where(~_hit(docs.sparkSession.sparkContext.broadcast(windows))(F.col(text_col)))
    return current


def _hit(windows):
    @F.arrow_udf("boolean")
    def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = windows.value
        for parts in bounded(texts):
            found = []
            for part in parts:
                for _, ids, first, lengths in _chunks(part.cast(pa.binary()).to_pylist(), w):
                    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
                    start, _ = w.occurrences(ids, first[doc], (first + lengths)[doc])
                    found.append(np.isin(np.arange(len(lengths)), doc[start]))
            yield pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return hit
