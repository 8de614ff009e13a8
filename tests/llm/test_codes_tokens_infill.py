"""Vector codes, token counts and fill-in-middle against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callweave.llm import codes, infill, token_counts
from callweave.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, v string, slot int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.Merges.load())


def counted(library, texts):
    return [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_is_split_alike(counter, library):
    every = "".join(f";{chr(c)}a{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert list(counter.pre_tokens(every)) == [every[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(every)]


def test_counts_are_those_of_the_library(counter, library):
    rng = random.Random(5)
    scripts = ["etaoin shrdlu'", "aab =-_", "漢字かな交じり文。", "éßñ ü", "\n\t \r\x0b\x85 x", "0123456789.,", "\U0001f600\U0001f468‍́", "𐥀՘Ƛẞ"]
    texts = ["".join(rng.choice(s) for _ in range(rng.randint(0, 60))) for s in scripts * 60]
    texts += ["".join(rng.choice("".join(scripts)) for _ in range(400)) for _ in range(100)]
    texts += ["", " ", "y" * 10_001, "=-" * 3000, "a<|endoftext|>b <|endoftext|><|endoftext|", "don't I'LL we've", "a" * 100_000 + " b" * 300_000]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)))
    assert counter.count(texts).tolist() == counted(library, texts)


def test_a_small_memory_changes_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "AT_ONCE", 7)
    monkeypatch.setattr(token_counts, "KEEP", 3)
    texts = ["one two three four five six seven eight nine ten", "", "one, two and twenty-two thousand", "  x  "] * 3
    assert counter.count(texts).tolist() == counted(library, texts)


def test_token_counts_of_a_table(spark, sf, documents, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, counted(library, [r.text or "" for r in rows]))}
    odd = [(1, None), (2, ""), (None, "hello there"), (None, "hello there"), (3, "hello there"), (4, "x y " * 50_000), (5, "漢" * 3000)]
    found = token_counts.count_tokens(documents(odd), carry=True)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "row"]
    want = [(i, len((t or "").encode()), n, n > 512, t) for (i, t), n in zip(odd, counted(library, [t or "" for _, t in odd]))]
    key = str
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.row.text) for r in found.collect()), key=key) == sorted(want, key=key)


def test_other_vocabularies_are_refused(tmp_path):
    import json

    held = json.load(open(token_counts.VOCABULARY, encoding="utf-8"))
    held["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(held))
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Merges.load(str(path))


def plain_codes(rows, parts, entries, rounds):
    """(codes, errors, codebooks) of vectors in the order of their ids, by loops."""
    whole = [[int(np.floor(np.float64(x) * 256)) for x in v] for v in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else entry for e, entry in enumerate(books[p])]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{e:02x}" for _, e in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("scale,copies", [(1.0, 1), (0.01, 1), (3000.0, 1), (1.0, 40)])
def test_codes_equal_plain_ones(spark, scale, copies):
    rng = np.random.default_rng(7)
    vectors = (np.round(rng.normal(0, scale, (120, 8)), 3).astype(np.float32) - np.float32(scale)).tolist()
    vectors = vectors[:20] + vectors[5:10] * copies + vectors[20:]  # equal vectors under other ids
    rows = [(i * 3, v, None if i % 4 == 0 else i % 3, "x", 1) for i, v in enumerate(vectors)]
    odd = [(1, None, 1, "x", 1), (2, [1.0] * 7 + [float("nan")], 1, "x", 1), (4, [float("inf")] + [1.0] * 7, 1, "x", 1), (5, [None] + [1.0] * 7, 1, "x", 1)]
    frame = spark.createDataFrame(odd + rows, VECTORS).repartition(5)
    got = codes.compress(frame, parts=4, entries=10, rounds=2).orderBy("vec_id").collect()
    code, error, books = plain_codes(vectors, 4, 10, 2)
    assert [(r.vec_id, r.code, r.error) for r in got] == [(r[0], c, e) for r, c, e in zip(rows, code, error)]
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    assert [r.label_error for r in got] == [by_label[r[2]] for r in rows]


def test_cells_lose_no_nearest_entry():
    rng = np.random.default_rng(3)
    for width, spread, size in ((1, 5, 64), (2, 3, 64), (4, 40, 64), (4, 40, 1), (12, 100, 30)):
        entries, rows = (np.floor(rng.normal(0, spread, (n, width))).astype(np.int64) for n in (size, 3000))
        cells = codes.Cells(np.concatenate([entries, entries[:5]]))  # repeated entries: the lower index wins
        gaps = ((rows[:, None] - cells.entries) ** 2).sum(2)
        for _ in range(2):  # computed, then remembered
            index, gap = cells.nearest(rows)
            assert (index == gaps.argmin(1)).all() and (gap == gaps.min(1)).all()
        cells.coords = cells.coords + 1  # as if every remembered cell were another one with the same hash
        assert (cells.nearest(rows)[0] == gaps.argmin(1)).all()


def test_awkward_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codes.compress(none).count() == 0
    only_odd = spark.createDataFrame([(1, None, 1, "x", 1), (2, [float("nan")] * 16, None, "x", 1)], VECTORS)
    assert codes.compress(only_odd).count() == 0
    same = spark.createDataFrame([(None, [0.5] * 16, None, "x", 1)] * 3 + [(7, [0.5] * 16, 1, "x", 1)] * 2, VECTORS)
    got = codes.compress(same).collect()
    assert len(got) == 5 and {(r.code, r.error, r.label_error) for r in got} == {("00" * 16, 0, 0)}
    for bad in ([0.5] * 17, [1e30] * 16):
        with pytest.raises(Exception, match="components|too large"):
            codes.compress(spark.createDataFrame([(1, [0.5] * 16, 1, "x", 1), (2, bad, 1, "x", 1)], VECTORS)).collect()


def test_decoded_vectors_are_near(spark, sf):
    points = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = codes.fit(points)
    read = codes.decode(codes.encode(points, books), books).join(points, "vec_id").toPandas()
    off = [((np.array(a) - np.array(b)) ** 2).sum() for a, b in zip(read.approx, read.embedding)]
    assert len(read) == points.count() and np.mean(off) < 0.6  # unit vectors: 1 without any code


TEXTS = [(i, " ".join(f"word{j}é\U0001f600\n" for j in range(i % 9))) for i in range(400)]
ODD = [(None, "null id"), (None, "null id"), (900, None), (901, ""), (902, "has <S> inside"), (903, "a<<P"), (904, "x" * 200_000), (905, "\n"), (905, "\n"), (906, "<M>")]


def plain_infill(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or any(s in text for s in infill.SIGNS) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark, documents):
    rows = TEXTS + ODD
    done = infill.rearrange(documents(rows), carry=True)
    back = done.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = str
    got = [(r.doc_id, r.row.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in back]
    assert sorted(got, key=key) == sorted(((i, t, plain_infill(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.row.text or "") for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_infill_by_words_and_uncovered_texts(spark, documents):
    rows = [(i, "one two  three four ") for i in range(50)] + [(99, "no end")]
    got = infill.rearrange(documents(rows), unit=r"\S+\s+", plain_share=0).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    cuts = {0, 4, 9, 15, 20}
    assert all(r.n == 4 and r.prefix_chars in cuts and r.prefix_chars + r.middle_chars in cuts for r in got if r.doc_id < 99)
    assert [(r.n, r.form) for r in got if r.doc_id == 99] == [(None, "plain")]
    assert all(r.back == r.output or r.form != "plain" for r in got) and {r.back for r in got} == {"one two  three four ", "no end"}


@pytest.mark.parametrize("signs", [("<P>", "<P>", "<M>"), ("<P>", "P><S", "<M>"), ("aXa", "b", "c"), ("", "b", "c"), ("ab", "a", "c")])
def test_signs_that_overlap_are_refused(signs):
    with pytest.raises(ValueError):
        infill.check_signs(signs)
