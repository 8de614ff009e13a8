"""Chat formatting at the level of tokens: control ids are spliced in, and text can never produce them."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices
from callweave.session import fill_slots

# The template, a conversation being a run of turns: <s>[INST]role[/INST]text</s>
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
BEGIN, END, OPEN, CLOSE = range(4)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Splits text before byte pairs are merged; fixed value of this kind of vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_QUOTE = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))
_UNQUOTE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Break every control string with a backslash after its first character; a backslash is doubled."""
    return _QUOTE.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return _UNQUOTE.sub(r"\1", text)


class Encoder:
    """Byte pairs of a public vocabulary; the control ids follow its last id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = tiktoken.Encoding("text", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 2

    def control(self, which: int) -> int:
        return self.first + which

    def turn(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Ids and loss mask of one turn. Each segment is encoded by itself; the mask is a prefix sum of its borders."""
        inside, said = self.tokens.encode_ordinary(escape(role)), self.tokens.encode_ordinary(escape(text))
        ids = [self.control(BEGIN), self.control(OPEN), *inside, self.control(CLOSE), *said, self.control(END)]
        border = np.zeros(len(ids) + 1, np.int8)
        if role == "assistant":
            border[3 + len(inside)] += 1
            border[3 + len(inside) + len(said)] -= 1
        return ids, np.cumsum(border)[:-1].tolist()

    def text(self, ids: list[int]) -> str:
        return self.tokens.decode_bytes(ids).decode()

    def formatted(self, ids: list[int]) -> str:
        """The text of ids, controls included."""
        out, plain = [], []
        for i in [*ids, self.first]:
            if i >= self.first:
                out.append(self.text(plain))
                out.append(CONTROLS[i - self.first])
                plain = []
            else:
                plain.append(i)
        return "".join(out[:-1])

    def read(self, ids: list[int], mask: list[int]) -> tuple[str, str, str]:
        """Role, text and text under the mask of a formatted turn, unescaped."""
        open_, close = ids.index(self.control(OPEN)), ids.index(self.control(CLOSE))
        end = ids.index(self.control(END))
        lossy = [i for i, m in zip(ids, mask) if m]
        return tuple(unescape(self.text(x)) for x in (ids[open_ + 1 : close], ids[close + 1 : end], lossy))


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Read on the driver; the vocabulary (under a megabyte) travels with the tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def format_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(conv_id, turn, ids, mask) per row of ``turns``; a conversation's tokens are those of its turns in order.

    Roles and texts are escaped, encoded by themselves and put between control ids, which no text can produce: control strings
    inside texts are broken by a backslash and encoded as plain text. The mask is 1 on the tokens of assistants' texts. Null roles
    and texts are empty. Turns stay rows of their own, so a conversation of any length is never gathered.
    """
    base = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sent = turns.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches):
        encoder = Encoder(sent.value)
        for batch in slices(batches):
            done = [encoder.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.list_(pa.int8()))],
                ["conv_id", "turn", "ids", "mask"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    return fill_slots(base, "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<byte>")


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the output of ``format_turns``.

    The digests run over whole conversations: turns are decoded in parallel, then each conversation streams, in order, through one
    running digest; nothing of it is held but the current batch. Turns without a number come first, ties in ``turn`` are ordered
    by role and text; rows without a conversation id form one conversation.
    """
    sent = formatted.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = formatted.schema["conv_id"].dataType.simpleString()
    order = formatted.schema["turn"].dataType.simpleString()

    def decode(batches):
        encoder = Encoder(sent.value)
        for batch in slices(batches):
            ids, masks = batch.column("ids").to_pylist(), batch.column("mask").to_pylist()
            parts = [encoder.read(i, m) for i, m in zip(ids, masks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), *(pa.array([p[k] for p in parts], pa.string()) for k in range(3)),
                 pa.array([len(encoder.formatted(i)) for i in ids], pa.int64())],
                ["conv_id", "turn", "role", "text", "loss", "chars"],
            )

    def digest(batches):
        current, out = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def finished():
            return pa.RecordBatch.from_arrays(
                [conv, pa.array([out[0]], pa.int64()), pa.array([out[1].hexdigest()]), pa.array([out[2]], pa.int64()), pa.array([out[3].hexdigest()]), pa.array([out[4]], pa.int64())], names
            )

        for batch in slices(batches):
            ids = batch.column("conv_id").to_pylist()
            for i, (cid, role, text, loss, chars) in enumerate(zip(ids, *(batch.column(c).to_pylist() for c in ("role", "text", "loss", "chars")))):
                if out is None or cid != current:
                    if out is not None:
                        yield finished()
                    current, conv, out = cid, batch.column("conv_id").slice(i, 1), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                out[0] += 1
                out[1].update(f"{role}\n{text}\n".encode())
                out[2] += len(loss)
                out[3].update(loss.encode())
                out[4] += chars
        if out is not None:
            yield finished()

    turns = formatted.mapInArrow(decode, f"conv_id {kind}, turn {order}, role string, text string, loss string, chars long")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
