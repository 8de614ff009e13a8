"""SentencePiece encoding and decoding: the N best segmentations over the lattice of pieces."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices
from callweave.session import fill_slots

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
# Segments up to this many characters are decoded together, longer ones one by one, with the same result.
TOGETHER = 64
_NOT_A_PIECE = "￿"
# Segments that no piece crosses: words with the spaces before them, and runs of line ends.
_SEGMENT = re.compile(r" *[^ \n]+| +|\n+")


class Vocabulary:
    """Pieces with log probabilities.

    The public file holds merge ranks instead of probabilities; by Zipf's law a piece's probability is taken as
    proportional to 1 / (rank + 10). A byte, used for what has no piece, costs as much as twice the last rank.
    """

    def __init__(self, model: bytes):
        known = sentencepiece.SentencePieceProcessor(model_proto=model)
        ordinary = [i for i in range(known.get_piece_size()) if not (known.is_control(i) or known.is_unknown(i) or known.is_byte(i))]
        total = math.log(sum(1 / (rank + 10) for rank in range(len(ordinary))))
        self.pieces = {known.id_to_piece(i): (i, -math.log(rank + 10) - total) for rank, i in enumerate(ordinary)}
        self.byte_score = -math.log(2 * len(ordinary)) - total
        self.bytes = {int(known.id_to_piece(i)[1:-1], 16): i for i in range(known.get_piece_size()) if known.is_byte(i)}
        # Every prefix of a piece: (log probability, ids) of a piece, () of a mere prefix.
        self.prefixes: dict[str, tuple] = {p[:i]: () for p in self.pieces for i in range(1, len(p))}
        self.prefixes.update({p: (score, (i,)) for p, (i, score) in self.pieces.items()})
        crossing = [p for p in self.pieces if "\n" in p or re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing or len(self.bytes) != 256:
            raise ValueError("pieces must not cross spaces or line ends, and every byte needs an id")
        self._number_prefixes()
        self.plain = {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}

    def _number_prefixes(self) -> None:
        """The prefixes as numbered nodes (0: none), which arrays of characters can follow; a space stands for ``SPACE``."""
        node = {p: i for i, p in enumerate(self.prefixes, 1)}
        kinds = {c: i for i, c in enumerate(sorted({p[-1] for p in node}), 1)}
        self.width = len(kinds) + 1
        self.kind = np.zeros(0x110000, np.int32)
        for c, i in kinds.items():
            self.kind[ord(" " if c == SPACE else c)] = i
        self.root = np.zeros(self.width, np.int64)
        for p in node:
            if len(p) == 1:
                self.root[kinds[p]] = node[p]
        follow = sorted((node[p[:-1]] * self.width + kinds[p[-1]], i) for p, i in node.items() if len(p) > 1)
        self.keys, self.targets = (np.array(x, np.int64) for x in zip(*follow, (np.iinfo(np.int64).max, 0)))
        self.gain = np.array([-math.inf] + [e[0] if e else -math.inf for e in self.prefixes.values()])
        self.node_id = np.array([0] + [e[1][0] if e else 0 for e in self.prefixes.values()], np.int32)
        self.byte_id = np.array([self.bytes[b] for b in range(256)], np.int32)

    def lattice(self, segment: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Forward Viterbi scores of every prefix, and for each end the edges that end there: (start, log probability, ids)."""
        shown = segment.replace(SPACE, _NOT_A_PIECE).replace(" ", SPACE)  # a literal U+2581 is encoded as bytes
        get, n = self.prefixes.get, len(shown)
        edges: list = [[] for _ in range(n + 1)]
        forward = [0.0] + [-math.inf] * n
        for start in range(n):
            base = forward[start]
            alone = get(shown[start])
            if not alone:
                raw = segment[start].encode()
                score = self.byte_score * len(raw)
                edges[start + 1].append((start, score, tuple(self.bytes[b] for b in raw)))
                if base + score > forward[start + 1]:
                    forward[start + 1] = base + score
            for end in range(start + 1, n + 1):
                piece = get(shown[start:end])
                if piece is None:
                    break
                if piece:
                    score = piece[0]
                    edges[end].append((start, score, piece[1]))
                    if base + score > forward[end]:
                        forward[end] = base + score
        return forward, edges

    def two_best(self, segment: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and log probability of the likeliest segmentation, and what the second best loses: Viterbi with two scores a prefix."""
        shown = segment.replace(SPACE, _NOT_A_PIECE).replace(" ", SPACE)
        get, n, none = self.prefixes.get, len(shown), -math.inf
        first, second, back = [0.0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        for start in range(n):
            one, two, last = first[start], second[start], start + 1
            piece = get(shown[start])
            if not piece:
                raw = segment[start].encode()
                here = (self.byte_score * len(raw), tuple(self.bytes[b] for b in raw))
            else:
                here = piece
            while True:
                if here:
                    score = one + here[0]
                    if score > first[last]:
                        lower = two + here[0]
                        second[last] = first[last] if first[last] > lower else lower
                        first[last], back[last] = score, (start, here[1])
                    elif score > second[last]:
                        second[last] = score
                last += 1
                if piece is None or last > n:
                    break
                piece = here = get(shown[start:last])
                if here is None:
                    break
        parts, at = [], n
        while at:
            at, ids = back[at]
            parts.append(ids)
        return tuple(chain.from_iterable(reversed(parts))), first[n], first[n] - second[n]

    def two_best_many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``two_best`` of many segments: all ids, their number, log probability and loss of the second best of each segment.

        Every step of the search is taken in all segments at once.
        """
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        if not len(segments):
            return np.zeros(0, np.int32), size, np.zeros(0), np.zeros(0)
        ends = np.cumsum(size + 1) - 1
        code = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        kind[ends] = 0
        in_utf8 = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        in_bytes = self.byte_score * in_utf8
        first, second = np.full(len(code), -math.inf), np.full(len(code), -math.inf)
        origin, through = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        first[ends - size] = 0.0

        def reach(last, start, one, two, gain, node):
            score, was = one + gain, first[last]
            better = score > was
            second[last] = np.where(better, np.maximum(was, two + gain), np.maximum(second[last], score))
            now = last[better]
            first[now], origin[now], through[now] = score[better], start[better], node[better]

        for step in range(int(size.max())):
            start = (ends - size)[size > step] + step
            one, two, last = first[start], second[start], start + 1
            node = self.root[kind[start]]
            alone = np.isneginf(self.gain[node])
            reach(last, start, one, two, np.where(alone, in_bytes[start], self.gain[node]), np.where(alone, 0, node))
            while len(on := np.flatnonzero(node)):
                start, last, one, two, node = start[on], last[on], one[on], two[on], node[on]
                key = node * self.width + kind[last]
                found = np.searchsorted(self.keys, key)
                node, last = np.where(self.keys[found] == key, self.targets[found], 0), last + 1
                on = np.flatnonzero(~np.isneginf(self.gain[node]))
                reach(last[on], start[on], one[on], two[on], self.gain[node[on]], node[on])
        # The places where a piece of the best segmentation ends, from the last to the first; then their ids in text order.
        used, at = np.zeros(len(code), bool), ends[size > 0]
        begin = (ends - size)[size > 0]
        while len(at):
            used[at] = True
            at = origin[at]
            at, begin = at[at > begin], begin[at > begin]
        at = np.flatnonzero(used)
        raw = through[at] == 0
        number = np.zeros(len(code) + 1, np.int64)
        number[at + 1] = np.where(raw, in_utf8[at - 1], 1)
        flat = np.repeat(self.node_id[through[at]], number[at + 1])
        sent = code[at[raw] - 1].tobytes().decode("utf-32-le").encode()
        flat[np.repeat(raw, number[at + 1])] = self.byte_id[np.frombuffer(sent, np.uint8)]
        before = np.cumsum(number)
        return flat, before[ends + 1] - before[ends - size], first[ends], first[ends] - second[ends]

    def n_best(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` likeliest segmentations, best first.

        Forward: Viterbi scores of every prefix. Backward: A* from the end, where the score of the rest is known exactly, so the
        complete paths come off the heap in their order. No more than the ``n`` best ways from a place to the end can be part of an
        answer, so a place is left at most ``n`` times. Equal scores come in the order met, which the segment alone decides.
        """
        forward, edges = self.lattice(segment)
        heap: list = [(-forward[-1], 0, len(segment), 0.0, None)]
        out, met, left = [], 0, [n] * (len(segment) + 1)
        while heap and len(out) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if not left[at]:
                continue
            left[at] -= 1
            if not at:
                ids: list[int] = []
                while path:
                    piece, path = path
                    ids += piece
                out.append((done, tuple(ids)))
                continue
            for start, score, piece in edges[at]:
                score += done
                met += 1
                heapq.heappush(heap, (-score - forward[start], met, start, score, (piece, path)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space put before the text is taken off."""
        return b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Segments:
    """What is known of segments: their ids, log probability and the loss of the second best.

    The table is emptied when it would hold more than ``keep`` segments, or eight ids for each of them.
    """

    def __init__(self, vocabulary: Vocabulary, n: int, keep: int = 200_000):
        self.vocabulary, self.n, self.keep = vocabulary, n, keep
        self._empty()

    def _empty(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.size, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.row]
        if self.row and (len(self.row) + len(new) > self.keep or len(self.flat) > 8 * self.keep):
            self._empty()
            new = list(parts)
        if not new:
            return
        short, long = [p for p in new if len(p) <= TOGETHER], [p for p in new if len(p) > TOGETHER]
        flat, size, score, loss = self.vocabulary.two_best_many(short)
        alone = [self.vocabulary.two_best(p) for p in long]
        size = np.concatenate([size, np.array([len(a[0]) for a in alone], np.int64)])
        self.row.update(zip(short + long, range(len(self.row), len(self.row) + len(new))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat, *(np.array(a[0], np.int32) for a in alone)])
        self.score = np.concatenate([self.score, score, [a[1] for a in alone]])
        self.loss = np.concatenate([self.loss, loss, [a[2] for a in alone]])

    def encode(self, text: str):
        """Ids and log probability of the best segmentation of a whole text, and the next best ones."""
        ids, score, others = next(self.encode_many([text]))
        return ids.tolist(), score, others

    def encode_many(self, texts: Iterable[str], chars: int = 1_000_000):
        """``encode`` of every text; the segments of about ``chars`` characters of text are looked up together."""
        held: list[list[str]] = []
        total = 0
        for text in texts:
            held.append(_SEGMENT.findall(" " + text) if text else [])
            total += len(text)
            if total >= chars:
                yield from self._encode(held)
                held, total = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[list[str]]):
        self._learn(set(chain.from_iterable(held)))
        for parts in held:
            yield self._assemble(parts) if parts else (np.zeros(0, np.int32), 0.0, [])

    def _ranked(self, segment: str, ids: np.ndarray) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentation as it stands in the text, then the others; among equals any may be the first."""
        own = tuple(ids.tolist())
        found = self.vocabulary.n_best(segment, self.n)
        return [(found[0][0], own), *(x for x in found if x[1] != own)][: self.n]

    def _assemble(self, parts: list[str]) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Segments are independent, so the best text is made of best segments, and the n-th best differs from it only in the n - 1
        segments whose second best loses least. An alternative is its loss and its changes (first id, ids replaced, new ids).
        """
        rows = np.fromiter(map(self.row.__getitem__, parts), np.int64, len(parts))
        size, loss = self.size[rows], self.loss[rows]
        starts = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.start[rows] - starts, size) + np.arange(int(size.sum()))]
        few = np.argsort(loss, kind="stable")[: max(1, self.n - 1)]
        few = [int(i) for i in few if np.isfinite(loss[i])]
        best = [self._ranked(parts[i], ids[starts[i] : starts[i] + size[i]]) for i in few]
        heap, seen, others = [(0.0, (0,) * len(few))], set(), []
        while heap and len(others) < self.n:
            lost, ranks = heapq.heappop(heap)
            changes = [(int(starts[i]), int(size[i]), found[r][1]) for i, r, found in zip(few, ranks, best) if r]
            others.append((lost, sorted(changes)))
            for k in range(len(few)):
                if ranks[k] + 1 < len(best[k]):
                    further = ranks[:k] + (ranks[k] + 1,) + ranks[k + 1 :]
                    if further not in seen:
                        seen.add(further)
                        heapq.heappush(heap, (sum(f[0][0] - f[r][0] for f, r in zip(best, further)), further))
        return ids, math.fsum(self.score[rows].tolist()), others[1:]


CHANGE = "struct<at:int,drop:int,ids:array<int>>"


def _load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_best: int = N_BEST, vocabulary: str = VOCABULARY, read_back: bool = False
) -> DataFrame:
    """(doc_id, ids, score, others) per row of ``docs``, and with ``read_back`` the text that :func:`decode` reads from the ids.

    ``ids`` are the pieces of the likeliest segmentation of the whole text (a forward pass that keeps the two best scores of a place finds them; the
    backward search serves the segments in which the next best texts differ), ``score`` its log probability, ``others`` the next
    ``n_best`` - 1 ones, each as its loss and its changes to ``ids``. The vocabulary file is read by the driver and travels with the tasks
    (half a megabyte). Null and empty text has no pieces, score 0 and no others. Nothing is shuffled. Reading back here takes no
    second Python worker beside that of a task, with a vocabulary of its own.
    """
    base = fill_slots(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(_load(vocabulary))
    change = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("loss", pa.float64()), ("changes", pa.list_(change))]))

    def run(batches):
        segments = _cached(sent, n_best)
        for batch in slices(batches, 300):
            done = list(segments.encode_many(batch.column("text").to_pylist()))
            sizes = np.cumsum([0] + [len(d[0]) for d in done]).astype(np.int32)
            flat = np.concatenate([d[0] for d in done])
            others = [[{"loss": x, "changes": [dict(zip(("at", "drop", "ids"), c)) for c in changes]} for x, changes in d[2]] for d in done]
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array([d[1] for d in done], pa.float64()), pa.array(others, other)]
            if read_back:
                columns.append(pa.array([segments.vocabulary.decode(d[0].tolist()) for d in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", "score", "others", *(["text"] if read_back else [])]
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, score double, others array<struct<loss:double,changes:array<{CHANGE}>>>"
    return base.mapInArrow(run, f"{schema}, text string" if read_back else schema)


_CACHE: dict = {}


def _cached(sent, n_best: int) -> Segments:
    """One table of segments for all tasks of a worker."""
    key = (hash(sent.value), n_best)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Segments(Vocabulary(sent.value), n_best)
    return _CACHE[key]


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with a column ``text``, read back from its ids; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(_load(vocabulary))
    kept = [c for c in encoded.columns if c != "text"]
    base = encoded.select(*kept)

    def run(batches):
        vocabulary_ = _cached(sent, N_BEST).vocabulary
        for batch in slices(batches, 300):
            column = batch.column(ids_col)
            texts = [None if not column[i].is_valid else vocabulary_.decode(column[i].values.to_numpy(zero_copy_only=False).tolist()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, text string")
