"""Vocabularies and document-term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import text as tx
from callweave.operators.filters import first_rows, hash_rank, nth_smallest
from callweave.session import checked_broadcast, is_small, materialise


def term_counts(docs: DataFrame, text: str = "text", lowercase: bool = True) -> DataFrame:
    """Corpus frequency of every term; counted per task before the shuffle."""
    return (
        docs.select(F.explode(tx.each(tx.vectorizer_tokenize(F.col(text), lowercase))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def union_vocab(*parts: DataFrame) -> DataFrame:
    """Set union of term columns."""
    merged = parts[0].select("term")
    for part in parts[1:]:
        merged = merged.unionByName(part.select("term"))
    return merged.distinct()


def term_cleanup(vocab: DataFrame) -> DataFrame:
    return vocab.where(tx.is_clean_term(F.col("term")))


def build_vocab(
    docs: DataFrame, seeds: DataFrame, min_tf: int = 15, text: str = "text", lowercase_vocab: bool = True
) -> DataFrame:
    """Terms seen more than ``min_tf`` times together with the seed words, cleaned."""
    frequent = term_counts(docs, text, lowercase_vocab).where(F.col("tf") > min_tf)
    word = F.lower("word") if lowercase_vocab else F.col("word")
    return term_cleanup(union_vocab(seeds.select(word.alias("term")), frequent))


def vocab_max_features(
    docs: DataFrame, stop: list[str], max_features: int = 10_000, sample: int = 100_000, text: str = "text"
) -> DataFrame:
    """The most frequent terms of the first documents, without stop words; ties go by term."""
    head = first_rows(docs.select("doc_id", text), "doc_id", sample)
    counted = term_counts(head, text).where(~F.col("term").isin(stop))
    order = F.struct((-F.col("tf")).alias("number"), "term")
    counted = materialise(counted.withColumn("number", -F.col("tf")).withColumn("order", order), "terms")
    cut = nth_smallest(counted, "number", "order", max_features)
    if cut is not None:
        last = F.struct(F.lit(cut["number"]).cast("long").alias("number"), F.lit(cut["term"]).alias("term"))
        counted = counted.where(F.col("order") <= last)
    return counted.select("term", "tf")


def term_array(tokens: Column, stop: list[str], max_n: int = 2) -> Column:
    """Unigrams and adjacent pairs of a token array; stop words are removed before pairing."""
    kept = tx.drop_words(tokens, stop)
    if max_n == 1:
        return kept
    pairs = F.transform(F.filter(tx.neighbours(kept), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.concat(kept, pairs)


def document_terms(docs: DataFrame, stop: list[str], text: str = "text", max_n: int = 2, keep=("doc_id",)) -> DataFrame:
    """One row per unigram (and adjacent pair) of a document, stop words removed before pairing."""
    tokens = tx.drop_words(tx.vectorizer_tokenize(F.col(text)), stop)
    one = docs.select(*keep, tokens.alias("tokens"))
    if max_n == 1:
        return one.select(*keep, F.explode(tx.each(F.col("tokens"))).alias("term"))
    pairs = F.transform(
        F.filter(tx.neighbours(F.col("tokens")), lambda p: p["b"].isNotNull()),
        lambda p: F.concat_ws(" ", p["a"], p["b"]),
    )
    return one.select(*keep, F.explode(tx.each(F.concat("tokens", pairs))).alias("term"))


def count_vectorize(
    docs: DataFrame, vocab: DataFrame, stop: list[str], text: str = "text", max_n: int = 2, by: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Long-format counts (document, term, tf) of the vocabulary terms; ``by`` counts them per other columns, such as the topic.

    Within the bound the vocabulary filters the terms before they are counted; beyond it the counts
    come first, so that a frequent term meets the join once per document only. Pairs hold a space; they are built
    only if a term of the vocabulary does.
    """
    vocab = materialise(vocab.select("term"), "vocab")
    if max_n > 1 and vocab.where(F.col("term").contains(" ")).isEmpty():
        max_n = 1
    terms = document_terms(docs, stop, text, max_n, by)
    tf = F.count(F.lit(1)).alias("tf")
    if is_small(vocab):
        return terms.join(F.broadcast(vocab), "term", "left_semi").groupBy(*by, "term").agg(tf)
    return terms.groupBy(*by, "term").agg(tf).join(vocab, "term", "left_semi").select(*by, "term", "tf")


def token_dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Dense term ids with document frequency.

    Each document counts a term once because its tokens are made distinct inside the row; no
    distinct aggregate is needed. Ids follow a hash order, which spreads the ranking evenly.
    """
    df = (
        docs.select(F.explode(tx.each(F.array_distinct(tx.whitespace_tokenize(F.col(text))))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return hash_rank(df, "term", name="id").select("term", "id", "df")


def decayed_weights(docs: DataFrame, period: str, topic: str = "topic", text: str = "text", stop: list[str] = (),
                    decay: float = 0.01) -> DataFrame:
    """Term weights per topic after the last period, every period shrinking the earlier ones.

    Closed form of the incremental rule: a count made ``s`` periods before the last one weighs
    ``(1 - decay) ** s``.
    """
    periods = docs.select(period).distinct()
    step = periods.select(
        period, (F.row_number().over(Window.orderBy(F.col(period).desc())) - 1).alias("_age")
    )
    counted = (
        document_terms(docs, list(stop), text, 1, keep=(period, topic))
        .groupBy(period, topic, "term")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    weight = F.col("_n") * F.pow(F.lit(1.0 - decay), F.col("_age"))
    return counted.join(checked_broadcast(step), period).groupBy(topic, "term").agg(F.sum(weight).alias("weight"))
