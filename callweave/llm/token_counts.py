"""Token counts: pre-tokens of many texts are merged together in ragged arrays, every one by its own lowest rank at each step."""

from __future__ import annotations

import itertools
import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from callweave.llm.common import keyed, slices
from callweave.session import fill_slots

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Fixed value: the split of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
# Pre-tokens that are taken at once, and remembered counts of short ones.
AT_ONCE, KEEP, SHORT = 200_000, 400_000, 32
NONE = np.iinfo(np.int32).max


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: printable Latin-1 signs stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(256)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def other_signs() -> list[int]:
    """Code points that ``regex`` knows as letters, numbers or spaces, while the tokenizer's older tables do not.

    Only code points that ``unicodedata`` does not know either can be among them, so these are put to the library's own split.
    """
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    new = [c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn"]
    probe = "".join(f"a{c}\n1{c}\n" for c in new)
    ours, theirs = {m.span() for m in regex.finditer(PATTERN, probe)}, {span for _, span in ByteLevel(add_prefix_space=False).pre_tokenize_str(probe)}
    return sorted({ord(new[a // 6]) for a, _ in ours ^ theirs})


class Merges:
    """Ranks of symbol pairs, as sorted arrays: what travels to the tasks (a megabyte)."""

    def __init__(self, first: np.ndarray, pairs: list[tuple[int, int, int]], special: list[str]):
        self.first, self.special = first.astype(np.int32), special
        self.other = other_signs()
        left, right, new = np.array(pairs, np.int64).reshape(-1, 3).T
        self.size = int(max(a.max(initial=0) for a in (left, right, new, first))) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int32), new[order].astype(np.int32)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Merges:
        """Read on the driver. Only a byte-level BPE without prefix spaces, unknown or stripping signs is counted right, so anything else is refused."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, split = held["model"], held["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or not level or held["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not counted")
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        return cls(np.array([ids[c] for c in byte_signs()]), pairs, [t["content"] for t in held["added_tokens"]])

    def places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair merges, and its place among the sorted pairs."""
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool), at

    def ranks(self, left: np.ndarray, right: np.ndarray, inner: np.ndarray) -> np.ndarray:
        known, at = self.places(left, right)
        return np.where(known & inner, self.rank[at] if len(self.rank) else NONE, NONE).astype(np.int32)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols of each word that survive all merges.

        The words lie one after another in one array. At each step every word merges all places of its lowest-ranked pair, left
        to right where places overlap; a word without a pair is done and leaves the array.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        after = np.append(symbols[1:], 0).astype(np.int32)
        rank = self.ranks(symbols, after, np.append(word[1:] == word[:-1], False)) if len(symbols) else np.zeros(0, np.int32)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                out[word[starts[done]]] = lengths[done]
                live = np.repeat(~done, lengths)
                symbols, word, rank = symbols[live], word[live], rank[live]
                least, lengths = least[~done], lengths[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            # A run of places that follow each other is one symbol repeated: every second place merges.
            opens = np.append(True, np.diff(hit) != 1)
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
            symbols[hit] = self.new[self.places(symbols[hit], symbols[hit + 1])[1]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            rank[hit] = rank[hit + 1]  # no pair follows the last symbol of a word
            at = hit - np.arange(len(hit))  # places after the deletion
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.zeros(len(symbols), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            changed = np.flatnonzero(touched)
            nxt = np.minimum(changed + 1, len(symbols) - 1)
            rank[changed] = self.ranks(symbols[changed], symbols[nxt], (nxt > changed) & (word[nxt] == word[changed]))
        return out


class Counter:
    """Token counts of texts; remembers those of short pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.split = regex.compile(PATTERN)
        # Longest first: of added tokens that begin alike the longest counts.
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        # Code points of another class there are split like this sign; most texts have none beyond the first of them.
        self.shown = dict.fromkeys(merges.other, "\xa7")
        self.far = regex.compile(f"[{chr(merges.other[0])}-\U0010ffff]" if merges.other else r"(?!)")

    def pre_tokens(self, text: str):
        """The pre-tokens in order, one by one."""
        shown = text.translate(self.shown) if self.far.search(text) else text
        return (text[m.start() : m.end()] for m in self.split.finditer(shown))

    def blocks(self, texts: list[str]):
        """Lists of (text number, pre-tokens) with about ``AT_ONCE`` pre-tokens in all; a long text spans several of them."""
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in self.special.split(text):
                if len(part) <= AT_ONCE and not self.far.search(part):
                    pieces = iter([self.split.findall(part)])
                else:
                    stream = self.pre_tokens(part)
                    pieces = iter(lambda: list(itertools.islice(stream, AT_ONCE)), [])
                for piece in pieces:
                    held.append((i, piece))
                    size += len(piece)
                    if size >= AT_ONCE:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; every added token in it is one."""
        total = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            total[i] = sum(1 for _ in self.special.finditer(text))
        for block in self.blocks(texts):
            if len(self.known) > KEEP:
                self.known.clear()
            new = list(set().union(*(piece for _, piece in block)).difference(self.known))
            found = dict(zip(new, self.merges.count([t.encode() for t in new]).tolist()))
            self.known.update(found)
            for i, piece in block:
                total[i] += sum(map(self.known.__getitem__, piece))
            for t in found:
                if len(t) > SHORT:
                    del self.known[t]
        return total


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary: str = VOCABULARY, carry: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    Bytes are those of UTF-8. Texts are split into pre-tokens, the distinct new ones of a block are merged together in arrays, and
    the counts are summed up by text. The strings of added tokens inside a text count as one token each, as the tokenizer's library
    has it by default; none are added at the ends. Null and empty text has no bytes and no tokens.

    The vocabulary is read by the driver and travels with the tasks. Nothing is shuffled; a task holds a slice of texts, the pre-tokens of a
    block and a bounded memory of counts. A pre-token of many thousand letters takes as many steps as it has different pairs.
    ``carry`` adds the whole input row as a column ``row``.
    """
    base = fill_slots(keyed(docs, id_col, text_col, carry).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(Merges.load(vocabulary))
    row = ["row"] if carry else []

    def run(batches):
        counter = Counter(sent.value)
        for batch in slices(batches):
            n = counter.count(batch.column("text").to_pylist())
            size = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(n), pa.array(n > limit), *(batch.column(c) for c in row)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", *row],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    carried = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean{carried}")
