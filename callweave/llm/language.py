"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices
from callweave.session import fill_slots

# Bounds of the training: about this many labelled documents of each language; and the longest n-grams.
SAMPLE_DOCS, LONGEST = 2_000, 4
# A word is a letter with the letters and marks after it. Texts without marks and numerals are split by the quicker pattern.
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PLAIN, _ODD = re.compile(r"[^\W\d_]+"), re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]")
_KEEP = 300_000
# Seed of Spark's xxhash64.
_SEED = 42


def letters(text: str | None) -> list[str]:
    """Words of letters and their marks, lower-cased; numerals and other signs are no letters."""
    if not text:
        return []
    lower = text.lower()
    return (_WORDS if _ODD.search(lower) else _PLAIN).findall(lower)


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(longest: int):
    """Counts of words (kind 0) and n-grams (kind n) by language, summed up per batch."""

    def run(batches):
        for batch in slices(batches):
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen.setdefault(lang, Counter()).update(letters(text))
            rows: Counter = Counter()
            for lang, found in seen.items():
                for word, n in found.items():
                    rows[0, word, lang] += n
                    for size in range(1, longest + 1):
                        for g in grams(word, size):
                            rows[size, g, lang] += n
            if rows:
                kind, key, lang = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), pa.array(key), pa.array(lang), pa.array(list(rows.values()), pa.int64())], ["kind", "key", "lang", "n"]
                )

    return run


class Model:
    """Smoothed log frequencies of words (kind 0) and n-grams (kind n), one column a language, found by the hash of their text."""

    def __init__(self, langs: list[str], kind: np.ndarray, key: np.ndarray, n: np.ndarray, longest: int = LONGEST):
        self.langs, self.longest = langs, longest
        self.keys, self.values = [], []
        for k in range(longest + 1):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(key[at], kind="stable")]
            counts = n[at].reshape(len(at), len(langs)).astype(float)
            self.keys.append(key[at])
            self.values.append((np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * len(at))).astype(np.float32) if len(at) else np.zeros((0, len(langs)), np.float32))

    def find(self, kind: int, texts: list[str]) -> np.ndarray:
        """Rows of the texts, -1 for unknown ones."""
        keys = self.keys[kind]
        hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode(), _SEED) for t in texts), np.uint64, len(texts)).view(np.int64)
        if not len(keys):
            return np.full(len(texts), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def words(self, new: list[str]) -> np.ndarray:
        """Log frequencies of known words; of others the mean over their places of the longest known n-gram that starts there."""
        out = np.zeros((len(new), len(self.langs)))
        row = self.find(0, new)
        out[row >= 0] = self.values[0][row[row >= 0]]
        places = [(k, i) for k in np.flatnonzero(row < 0).tolist() for i in range(len(new[k]) + 2)]
        number = np.zeros(len(new))
        for n in range(self.longest, 0, -1):
            marked = [f"^{new[k]}$"[i : i + n] for k, i in places]
            found = self.find(n, marked)
            found[np.fromiter(map(len, marked), np.int64, len(marked)) < n] = -1
            told = np.flatnonzero(found >= 0)
            owner = np.array([places[t][0] for t in told], np.int64)
            np.add.at(out, owner, self.values[n][found[told]])
            np.add.at(number, owner, 1)
            places = [p for p, f in zip(places, found.tolist()) if f < 0]
        return out / np.maximum(number, 1)[:, None]


class _Rows(dict):
    """word -> row of a table of log frequencies; forgets all when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table = model, np.zeros((0, len(model.langs)))

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > _KEEP:
            self.clear()
            self.table = self.table[:0]
        new = list(set().union(*texts).difference(self))
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.table = np.concatenate([self.table, self.model.words(new)])

    def total(self, tokens: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return np.bincount(rows, minlength=len(self)) @ self.table if len(tokens) > len(self) else self.table[rows].sum(0)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, longest: int = LONGEST
) -> Model:
    """Learn from about ``sample_docs`` of the labelled texts of each language, chosen by a hash of id and text; repeated rows count once.

    Rows without text or language are not used. Words and n-grams seen once are left out, all others are kept: a rare language has as
    many documents to learn from as a common one, and the sample alone bounds the model, whose entries travel as a hash and a
    number for each language. Only the sample's counts are collected.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    hashed = named.withColumn("h", F.xxhash64("doc_id", "text"))
    rows = {r.lang: max(1, r.n) for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    langs = sorted(rows)
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), longest)
    sizes = F.create_map(*[F.lit(x) for lang in langs for x in (lang, rows[lang])])
    sample = hashed.where(F.pmod(F.col("h"), sizes[F.col("lang")]) < sample_docs).dropDuplicates(["lang", "h"])
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    counted = (
        fill_slots(sample.select("text", "lang"), "text").mapInArrow(_counts(longest), "kind int, key string, lang string, n long")
        .groupBy("kind", "key", place[F.col("lang")].alias("lang")).agg(F.sum("n").alias("n"))
        .groupBy("kind", F.xxhash64("key").alias("key")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).where("total > 1")
        .select("kind", "key", F.transform("by", lambda x: x["lang"]).alias("lang"), F.transform("by", lambda x: x["n"]).alias("n"))
    )
    told = counted.toArrow()
    kind, key = told["kind"].to_numpy(), told["key"].to_numpy()
    each = np.repeat(np.arange(len(kind)), [len(x) for x in told["lang"].to_numpy()]) if len(kind) else np.zeros(0, np.int64)
    n = np.zeros((len(kind), len(langs)), np.float32)
    if len(kind):
        np.add.at(n, (each, np.concatenate(told["lang"].to_numpy())), np.concatenate(told["n"].to_numpy()))
    return Model(langs, kind, key, n, longest)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``.

    The score is the posterior of the predicted language under equal priors. Null text and text without a letter (numerals are none) is ``und`` with
    score 0, and so is all text when nothing was learnt. Ties go to the first language in alphabetical order.
    """
    base = fill_slots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rows = _Rows(sent.value)
        langs = sent.value.langs
        for batch in slices(batches):
            names, scores = [], []
            split = [letters(text) for text in batch.column("text").to_pylist()]
            rows.learn(split)
            for tokens in split:
                if not tokens or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = rows.total(tokens)
                best = int(total.argmax())
                names.append(langs[best])
                scores.append(float(1 / math.fsum(np.exp(np.maximum(total - total[best], -700)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
