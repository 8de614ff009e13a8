from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from callweave.functions import text as tx
from callweave.operators import filters as fl
from callweave.operators import vocab as vc
from callweave.operators import words as wd
from callweave.sources import stores, transcripts as tr

CASES = ["a\\b", "x[1]", "R&&D", "in 2020 we", "É٣ x", "", "   ", "a b", "a b", "a\x0bb", "(it's) 50% off!", "tab\tand\nline"]


def expected_clean(text: str) -> str:
    for mark in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~":
        text = text.replace(mark, " ")
    return re.sub(r"\d+", "", re.sub(r"\s+", " ", text)).strip()


def one(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(expr).collect()]


def test_clean_matches_python(spark):
    assert one(spark, CASES, tx.remove_punct_digits(F.col("t"))) == [expected_clean(c) for c in CASES]


def test_clean_keeps_double_space_and_backslash(spark):
    assert one(spark, ["in 2020 we", "a\\b"], tx.remove_punct_digits(F.col("t"))) == ["in  we", "a\\b"]


def test_vectorizer_tokens(spark):
    got = one(spark, ["A bc d_e É2 x", ""], tx.vectorizer_tokenize(F.col("t")))
    assert got == [["bc", "d_e", "é2"], []]


def test_stop_words_ignore_case_and_keep_order(spark):
    df = spark.createDataFrame([(1, ["The", "Cat", "the", "a_the", "cat"]), (2, ["THE"])], "doc_id long, tokens array<string>")
    stop = tr.scan_word_list(spark.createDataFrame([(" THE ",), ("the",)], "w string"), "w")
    short = {r.doc_id: r.tokens for r in wd.remove_stopwords(df, stop).collect()}
    assert short == {1: ["Cat", "a_the", "cat"], 2: []}


def test_long_stop_list_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["The", "Cat", "the", "dog"]), (2, ["THE"]), (3, [])], "doc_id long, tokens array<string>")
    stop = spark.createDataFrame([("the",), ("dog",)], "word string")
    monkeypatch.setattr(wd, "word_set", lambda words: None)
    assert {r.doc_id: r.tokens for r in wd.remove_stopwords(df, stop).collect()} == {1: ["Cat"], 2: [], 3: []}


def test_sentence_without_words_leaves_a_space(spark):
    assert one(spark, ["Keep one. The. Keep two!"], tx.drop_words_by_sentence(F.col("t"), ["the", "the."])) == ["Keep one.  Keep two!"]


@pytest.mark.parametrize(
    "body, strict, want",
    [
        ("a|||Operator|||b|||c", True, ["b", "c"]),
        ("a|||b|||c", True, ["b", "c"]),
        ("a|||b|||c", False, ["a", "b", "c"]),
        ("a|||Operator", True, []),
        ("operator|||b", True, ["b"]),
        (None, True, []),
    ],
)
def test_segments(spark, body, strict, want):
    assert one(spark, [body], tx.transcript_segments(F.col("t"), strict)) == [want]


def test_safe_harbor(spark):
    rows = [["good year", "", "Forward looking remarks", "risk of future events", "risk and risk", "actual results"]]
    kept = one(spark, rows, tx.remove_safe_harbor(F.col("t")), "t array<string>")
    assert kept == [["good year", "risk and risk", "actual results"]]
    assert one(spark, rows, tx.has_safe_harbor(F.col("t")), "t array<string>") == [True]


def test_lexicon_and_lemmas(spark):
    lexicon = spark.createDataFrame([("ran", "run", "VERB"), ("red", "red", "ADJ")], "form string, lemma string, pos string")
    df = spark.createDataFrame([(1, ["red", "dogs", "ran", "ran"]), (2, ["red"])], "doc_id long, tokens array<string>")
    got = {r.doc_id: r.tokens for r in wd.lemmatize_pos(df, lexicon).collect()}
    assert got == {1: ["dogs", "run", "run"], 2: []}


def test_vocab_needs_more_than_the_minimum(spark):
    docs = spark.createDataFrame([(1, "Apple " * 15 + "berry " * 16 + "12 " * 20 + "ab " * 20)], "doc_id long, text string")
    seeds = spark.createDataFrame([("Seed",), ("99",)], "word string")
    assert {r.term for r in vc.build_vocab(docs, seeds).collect()} == {"seed", "berry"}


def test_large_vocabulary_path(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "big data big"), (2, "data")], "doc_id long, text string")
    vocab = spark.createDataFrame([("big",), ("data",), ("big data",)], "term string")
    small = {tuple(r) for r in vc.count_vectorize(docs, vocab, []).collect()}
    monkeypatch.setattr(vc, "is_small", lambda df: False)
    assert {tuple(r) for r in vc.count_vectorize(docs, vocab, []).collect()} == small
    assert (1, "big", 2) in small and (1, "big data", 1) in small


def test_missing_speaker_is_kept(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "speakertypeid int")
    assert {r[0] for r in fl.exclude_speaker(df).collect()} == {2, None}


def test_null_text_policies(spark):
    assert one(spark, [None, "x"], tx.cast_text(F.col("t"), "literal")) == ["nan", "x"]
    assert one(spark, [None, "x"], tx.cast_text(F.col("t"))) == [None, "x"]


def test_drop_columns_strict(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert fl.drop_columns(df, "b", "zzz").columns == ["a"]
    with pytest.raises(KeyError):
        fl.drop_columns(df, "zzz", strict=True)


def test_embedding_store_fails_when_absent(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stores.load_embeddings(spark, str(tmp_path), "a/b")
    stores.save_embeddings(spark.range(3), str(tmp_path), "a/b")
    assert (tmp_path / "embeddings_a_b").exists()
    assert stores.load_embeddings(spark, str(tmp_path), "a/b").count() == 3


def test_reuse_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    for _ in range(2):
        assert stores.load_or_build(spark, str(tmp_path / "t"), build).count() == 4
    assert len(calls) == 1


def test_most_frequent_terms_beyond_the_limit(spark):
    docs = spark.createDataFrame([(1, "aa aa aa bb bb cc cc dd ee"), (2, "aa ff")], "doc_id long, text string")
    got = vc.vocab_max_features(docs, ["aa"], max_features=3).collect()
    assert {(r.term, r.tf) for r in got} == {("bb", 2), ("cc", 2), ("dd", 1)}


def test_pairs_are_built_only_for_a_vocabulary_that_has_some(spark):
    from callweave.operators import vocab as vc

    docs = spark.createDataFrame([(1, "big cat big cat"), (2, "cat")], "doc_id long, text string")
    one = vc.count_vectorize(docs, spark.createDataFrame([("cat",)], "term string"), [])
    assert "concat_ws" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.term, r.tf) for r in one.collect()} == {(1, "cat", 2), (2, "cat", 1)}
    two = vc.count_vectorize(docs, spark.createDataFrame([("cat",), ("big cat",)], "term string"), [])
    assert {(r.doc_id, r.term, r.tf) for r in two.collect()} == {(1, "cat", 2), (1, "big cat", 2), (2, "cat", 1)}
