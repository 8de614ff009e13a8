"""Toxicity: disguised words are restored by a noisy-channel decoder before the text is scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import Rolling, WordHash, bounded, keyed, slices, text_bytes, words
from callweave.session import fill_slots

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c",
}
# A sign that stands for a letter may also stand for its accented forms.
ACCENTS = {"a": "áàâäãå", "c": "ç", "e": "éèêë", "i": "íìîï", "o": "óòôöõø", "s": "ß", "u": "úùûü", "n": "ñ", "y": "ýÿ"}
# Costs of the channel, as natural logarithms.
SWAP, ACCENT, REPEAT, BREAK = -1.0, -3.0, -0.5, -2.0
SAMPLE_LABELS, MIN_GROUPS, MIN_G, MIN_SHARE = 12_000, 4, 25.0, 0.8
THRESHOLD = 0.7
# A stem is a beginning of so many letters. It tells something where words share it at least this often, once in so many words.
STEMS, STEM_WORDS, STEM_EVERY = (4, 5, 6, 7), 2, 100
# It tells as much where some span of the text, or all of it, holds more than clean texts do by chance: at least so many words, and a log
# likelihood ratio against the clean rate above this plus the logarithm of the number of spans.
SPAN_WORDS, SPAN_LIMIT = 3, 14.0

_SIGNS = re.escape("".join(LEET))
# Letters with signs between or before them; single letters with one separator between them; a letter three times.
_LETTER = r"[^\W\d_]"
_ANY = rf"(?:{_LETTER}|[{_SIGNS}])"
_MIXED = re.compile(rf"(?<![\w{_SIGNS}])(?={_LETTER}*[{_SIGNS}])(?=[{_SIGNS}]*{_LETTER}){_ANY}{{3,}}")
_SPACED = re.compile(rf"(?<![\w{_SIGNS}]){_ANY}(?:([ ._*-]){_ANY})(?:\1{_ANY})+(?![\w{_SIGNS}])")
_LONG = re.compile(rf"\b{_LETTER}*({_LETTER})\1\1{_LETTER}*\b", re.IGNORECASE)
_STRETCH = re.compile(r"(.)\1{2,}")
# Of a stretch of equal signs no more than so many are told apart.
LONGEST_STRETCH = 8
_FLOOD = re.compile(rf"(.)\1{{{LONGEST_STRETCH},}}")
# Letters with a code of their own; 0 is whatever parts words, and all other letters share the last code.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
OTHER = len(ALPHABET) + 1
CODES = OTHER + 1


@cache
def _codes() -> np.ndarray:
    """Code of every code point."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            at = ALPHABET.find(c.lower())
            out[i] = at + 1 if at >= 0 and len(c.lower()) == 1 else OTHER
    return out


def _trigrams(batches):
    """Trigram counts of letters and word ends over whole texts; one row a trigram and task."""
    codes = _codes()
    total = np.zeros(CODES**3, np.int64)
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                padded = f"  {text} "
                points = np.frombuffer(padded.encode(), np.uint8) if text.isascii() else np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32)
                c = codes[points]
                np.add.at(total, (c[:-2] * CODES + c[1:-1]) * CODES + c[2:], 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])


def fit_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after the two before it, from all texts."""
    counted = fill_slots(docs.select(F.col(text_col).alias("text")), "text").mapInArrow(_trigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    n = np.zeros(CODES**3)
    for r in counted.collect():  # at most CODES ** 3 rows
        n[r.k] = r.n
    n = n.reshape(CODES, CODES, CODES) + 0.1
    return np.log(n / n.sum(2, keepdims=True))


def bare(shown: str) -> str:
    """``shown`` without signs at its ends that stand for nothing: some before it, and after it these or any sign three times or more.

    Both ends are found by their index, so the time is linear in the length, and longer stretches are cut down to ``LONGEST_STRETCH``.
    """
    text = shown.lstrip("|+(")
    end = len(text.rstrip("!|+(¡"))
    if text and not (text[-1].isalnum() or text[-1] == "_"):
        same = len(text.rstrip(text[-1]))
        if len(text) - same >= 3:
            end = min(end, same)
    return _FLOOD.sub(lambda m: m[1] * LONGEST_STRETCH, text[:end])


class Decoder:
    """Viterbi search over the lattice of what each sign may stand for."""

    def __init__(self, letters: np.ndarray, keep: int = 100_000):
        self.letters, self.keep, self.known = letters.tolist(), keep, {}
        self.codes = _codes()
        self.signs = {c: [(x, SWAP) for x in plain] + [(y, ACCENT) for x in plain for y in ACCENTS.get(x, "")] for c, plain in LEET.items()}

    def word(self, shown: str, separator: str = "") -> str:
        """The likeliest plain word behind ``shown``: a sign stands for a letter, a repeated letter may be dropped.

        A ``separator`` between letters vanishes, or parts two words. Punctuation at its ends, and any sign repeated three times at its end, hides nothing and stays away.
        """
        done = self.known.get(shown)
        if done is not None:
            return done
        if len(self.known) >= self.keep:
            self.known.clear()
        plain = bare(shown).lower()
        stretched = {i for m in _STRETCH.finditer(plain) for i in range(m.start() + 1, m.end())}
        # state: (letter before last, last letter) -> (score, link to the path)
        states = {(0, 0): (0.0, None)}
        for i, c in enumerate(plain):
            if c == separator:
                for (a, b), (score, path) in list(states.items()):
                    s = score + BREAK + self.letters[a][b][0]
                    if b and ((b, 0) not in states or states[b, 0][0] < s):
                        states[b, 0] = (s, (path, " "))
                continue
            options = self.signs.get(c) or [(c, 0.0)]
            step: dict = {}
            for (a, b), (score, path) in states.items():
                for letter, cost in options:
                    k = int(self.codes[ord(letter)])
                    s = score + cost + self.letters[a][b][k]
                    if (b, k) not in step or step[b, k][0] < s:
                        step[b, k] = (s, (path, letter))
                if i in stretched and path is not None and (not (s := step.get((a, b))) or s[0] < score + REPEAT):
                    step[a, b] = (score + REPEAT, path)
            states = step or states
        _, path = max(((score + self.letters[a][b][0], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, letter = path
            out.append(letter)
        self.known[shown] = plain = "".join(reversed(out))
        return plain

    def read(self, text: str) -> tuple[str, set[bytes], list[bytes]]:
        """The restored text, all words to be scored (as they stand, restored, and spaced ones without a first or last
        letter that may be a word of its own: ``such a s t u p i d thing``), and the restored words in order."""
        restored = self.restore(text)
        tokens = words(restored.encode())
        found = set(tokens) if restored == text else {*tokens, *words(text.encode())}
        for m in _SPACED.finditer(text):
            if len(m[0]) > 7:
                found.update(words(f"{self.word(m[0][2:], m[1])} {self.word(m[0][:-2], m[1])}".encode()))
        return restored, found, tokens

    def restore(self, text: str) -> str:
        """The text with its disguised words in plain letters, accented ones included; everything else stays."""
        text = _SPACED.sub(lambda m: self.word(m[0], m[1]), text)
        text = _MIXED.sub(lambda m: self.word(m[0]), text)
        return _LONG.sub(lambda m: self.word(m[0]), text)


def frequent(stems: Counter, n: int) -> set:
    """The stems that are frequent enough among ``n`` words; they are marked by a sign that no word has."""
    return {s + b"*" for s, m in stems.items() if m >= STEM_WORDS and m * STEM_EVERY >= n}


def dense(at: np.ndarray, n: int, rate: float) -> bool:
    """Whether words at the places ``at`` of a text of ``n`` words are too many for the clean ``rate``, in the whole text or a span of it."""
    width = 32
    while True:
        width = min(width, n)
        most = int((np.searchsorted(at, at + width) - np.arange(len(at))).max()) if len(at) else 0
        usual = rate * width
        if most >= SPAN_WORDS and most > usual and most * math.log(most / usual) - (most - usual) >= SPAN_LIMIT + math.log(n / width):
            return True
        if width == n:
            return False
        width *= 2


def all_stems(tokens: list[bytes]) -> Counter:
    """How many words begin with each stem."""
    out: Counter = Counter()
    for word, n in Counter(tokens).items():
        plain = word.decode("utf-8", "replace")
        for size in STEMS:
            if len(plain) >= size:
                out[plain[:size].encode()] += n
    return out


class Stems:
    """Given stems, found in words by their first four bytes."""

    def __init__(self, stems):
        self.by_head: dict[bytes, list[bytes]] = {}
        for s in stems:
            self.by_head.setdefault(s[:4], []).append(s)

    def places(self, tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        if self.by_head:
            for i, word in enumerate(tokens):
                for s in self.by_head.get(word[:4], ()):
                    if word.startswith(s):
                        out.setdefault(s, []).append(i)
        return out

    def told(self, tokens: list[bytes], rates: dict[bytes, float]) -> set[bytes]:
        """The stems, marked, that are frequent in the text or dense in a span of it."""
        found = self.places(tokens)
        often = frequent(Counter({s: len(at) for s, at in found.items()}), len(tokens))
        return often | {s + b"*" for s, at in found.items() if s + b"*" not in often and s in rates and dense(np.array(at), len(tokens), rates[s])}


def _rates(letters, stems: list[bytes]):
    """(word, n) over clean labelled texts as they are scored: words with each stem, and all words under the empty one."""

    def run(batches):
        decoder, known, total = Decoder(letters.value), Stems(stems), Counter()
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if text and not toxic:
                    tokens = decoder.read(text)[2]
                    total[b""] += len(tokens)
                    total.update({s: len(at) for s, at in known.places(tokens).items()})
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def _group(h: np.ndarray, rolling: Rolling) -> int:
    return int(rolling.windows(h, min(5, len(h))).min().view(np.int64))


def _features(letters):
    """(word, toxic, grp) of the labelled texts, frequent stems included; near copies mostly share a group, so they count about once."""

    def run(batches):
        decoder, hashes, rolling = Decoder(letters.value), WordHash(), Rolling(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                tokens = words(text.encode()) if text else []
                if tokens:
                    grp = _group(hashes.of(tokens), rolling)
                    _, found, plain = decoder.read(text)
                    for w in found | frequent(all_stems(plain), len(plain)):
                        out[0].append(w)
                        out[1].append(toxic)
                        out[2].append(grp)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["word", "toxic", "grp"])

    return run


def _presence(stems: list[bytes]):
    """(word, toxic, grp) of the labelled texts that hold a word with one of the stems, however rare."""

    def run(batches):
        known, hashes, rolling = Stems(stems), WordHash(), Rolling(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            out = []
            for text, toxic in zip(text_bytes(batch, "text"), batch.column("toxic").to_pylist()):
                tokens = words(text)
                here = known.places(tokens)
                if here:
                    grp = _group(hashes.of(tokens), rolling)
                    out += [(s, toxic, grp) for s in here]
            if out:
                word, toxic, grp = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()).cast(pa.string()), pa.array(toxic, pa.int32()), pa.array(grp, pa.int64())], ["word", "toxic", "grp"])

    return run


class Model:
    """Letter model, weights of words and of frequent stems (``stem*``), the log odds of a text without any of them, and the stems' rates in clean texts."""

    def __init__(self, letters: np.ndarray, weights: dict[str, float], prior: float, rates: dict[bytes, float]):
        self.letters, self.weights, self.prior, self.rates = letters, weights, prior, rates

    def logit(self, found: set[bytes]) -> float:
        """Words and stems whose first four letters are equal say the same thing, so the strongest of them counts."""
        best: dict[str, float] = {}
        for w in found:
            word = w.decode()
            best[word[:4]] = max(best.get(word[:4], 0.0), self.weights[word])
        return self.prior + math.fsum(best.values())


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_labels: int = SAMPLE_LABELS,
) -> Model:
    """Learn letters from all texts and word weights from about ``sample_labels`` labelled documents, chosen by a hash of the id.

    A word's weight is its log odds between toxic and other documents, if its likelihood ratio statistic is at least ``MIN_G``, it
    occurs in ``MIN_GROUPS`` groups of toxic texts, and these are ``MIN_SHARE`` of all it occurs in. So does a stem that is frequent in
    a text, as inflecting languages spread a stem over many words. Words of such a stem are left out if the stem's mere presence has a
    lower share than that: then one word of it says little. Texts to be scored have a stem where it is as frequent, or where a span of them
    holds more of it than the clean training texts' rate explains, so that length does not hide it. Documents with contradicting labels or none are not used.
    """
    letters = fit_letters(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(letters)
    clear = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    )
    rows = max(1, clear.count())
    sample = F.broadcast(clear.where(F.pmod(F.xxhash64("doc_id"), F.lit(rows)) < sample_labels))  # bounded by sample_labels
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id").select("text", "toxic")

    def by_word(find) -> DataFrame:
        seen = labelled.mapInArrow(find, "word string, toxic int, grp long").distinct()
        return seen.groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("f"))

    both = by_word(_features(sent))
    size = clear.where(F.pmod(F.xxhash64("doc_id"), F.lit(rows)) < sample_labels).agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    pos, neg = float(size[0] or 0), float(size[1] or 0)
    weight = F.log((F.col("t") + 0.5) / (pos + 1)) - F.log((F.col("f") + 0.5) / (neg + 1))

    def entropy(*counts):
        return sum((F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in counts), F.lit(0.0))

    t, f, n = F.col("t"), F.col("f"), pos + neg
    told = 2 * (
        entropy(t, f, pos - t, neg - f, F.lit(n)) - entropy(t + f, n - t - f, F.lit(pos), F.lit(neg))
    )
    top = (
        both.where((F.col("t") >= MIN_GROUPS) & (F.col("t") >= MIN_SHARE * (F.col("t") + F.col("f")))).select("word", weight.alias("w"), told.alias("g")).where(F.col("g") >= MIN_G)
        .collect()  # as many as the bounded sample proves
    )
    weights = {r.word: r.w for r in sorted(top, key=lambda r: (-r.g, r.word))}
    stems = [w[:-1].encode() for w in weights if w.endswith("*")]
    vague = [r.word for r in by_word(_presence(stems)).where(F.col("t") < MIN_SHARE * (F.col("t") + F.col("f"))).collect()] if stems else []
    kept = {w: x for w, x in weights.items() if w.endswith("*") or not w.startswith(tuple(vague))}
    seen = {r.word.encode(): r.n for r in labelled.mapInArrow(_rates(sent, stems), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()} if stems else {}
    rates = {s: (seen.get(s, 0) + 0.5) / (seen[b""] + 1) for s in stems} if b"" in seen else {}
    return Model(letters, kept, math.log((pos + 0.5) / (neg + 0.5)), rates)


class Judge:
    """A model at work in a task."""

    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model.letters)
        self.known = {w.encode() for w in model.weights}
        self.stems = Stems(w[:-1] for w in self.known if w.endswith(b"*"))

    def read(self, text: str | None) -> tuple[float, str | None]:
        """The chance that the text is toxic, and the restored text."""
        restored, found, tokens = self.decoder.read(text) if text else (text, set(), [])
        logit = self.model.logit(self.known & (found | self.stems.told(tokens, self.model.rates)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))), restored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, text) per row of ``docs``: the chance that the text is toxic, and the restored text.

    Null and empty text, and text without a weighted word or stem, gets the prior; null text stays null.
    """
    base = fill_slots(keyed(docs, id_col, text_col, False), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(sent.value)
        for batch in slices(batches):
            done = [judge.read(text) for text in batch.column("text").to_pylist()]
            scores, plain = zip(*done)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(plain, pa.string())], ["doc_id", "score", "text"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, score double, text string")


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column with the same score, for rows whose other columns need not pass through Python."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def chance(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(sent.value)
        for parts in bounded(texts):
            yield pa.array([judge.read(text)[0] for part in parts for text in part.to_pylist()], pa.float64())

    return chance
