"""Topic tables: term weights, rankings, labels, sizes, embeddings and plot frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.fixed import DOCUMENT_PALETTE, OUTLIER_COLOUR
from callweave.operators.cells import BLOCK_ROWS, blocked_self
from callweave.operators.cluster import Centres, mean_vectors
from callweave.operators.matrix import stack
from callweave.operators.reduce import reduce_for_plot
from callweave.session import checked_broadcast, materialise

RANK_DIGITS = 9


def class_tfidf(terms: DataFrame, by: list[str] = ("topic",), whole_average: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """Weight of each term in each topic from one row per (topic, term) occurrence or counted rows.

    ``tf / n_c * ln(1 + A / f_t)`` with n_c the terms of the topic, f_t the occurrences of the term
    and A the mean number of terms per topic, rounded down unless ``whole_average`` is false
    (Grootendorst, arXiv:2203.05794). ``by`` ends with the topic; columns before it name a model,
    so several models are weighted in one go. The text is counted once; all else reads the counts.
    With ``sizes`` (``*by, n_c``) the rows are counted ones of some terms only, and carry the ``f_t`` of all topics of their model.
    """
    by = list(by)
    model = by[:-1]
    counts = terms
    if sizes is None:
        tf = F.sum("tf") if "tf" in terms.columns else F.count(F.lit(1))
        counts = materialise(terms.groupBy(*by, "term").agg(tf.alias("tf")), "class-terms")
        sizes = counts.groupBy(*by).agg(F.sum("tf").alias("n_c"))
        counts = counts.withColumn("f_t", F.sum("tf").over(Window.partitionBy(*model, "term")))
    mean = F.avg("n_c").over(Window.partitionBy(*model) if model else Window.partitionBy(F.lit(1)))
    sizes = sizes.withColumn("_a", F.floor(mean) if whole_average else mean)
    weighted = counts.join(checked_broadcast(sizes), by)
    score = F.col("tf") / F.col("n_c") * F.log(1 + F.col("_a") / F.col("f_t"))
    return weighted.select(*by, "term", "tf", score.alias("score"))


def topk_terms(weights: DataFrame, k: int = 10, by: list[str] = ("topic",)) -> DataFrame:
    """The ``k`` heaviest terms per topic, ties by term; limited before the shuffle as well."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", RANK_DIGITS)), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(*by, "rank", F.col("term").alias("word"), "score")


def filter_empty_topics(words: DataFrame) -> DataFrame:
    """Rows with a word; a topic without any disappears."""
    return words.where(F.col("word").isNotNull() & (F.col("word") != ""))


def topic_word_lists(words: DataFrame, by: list[str] = ("topic",)) -> DataFrame:
    """Ordered word array per topic, outlier topic left out. At most k words per topic."""
    kept = filter_empty_topics(words).where(F.col(by[-1]) != -1)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"])
    return kept.groupBy(*by).agg(ordered.alias("words"))


def topic_label(words: Column, n: int = 3, mark: str = " - ") -> Column:
    return F.array_join(F.slice(words, 1, n), mark)


def topic_sizes(labelled: DataFrame, by: list[str] = ("topic",)) -> DataFrame:
    return labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def head_topics(sizes: DataFrame, n: int = 20) -> DataFrame:
    return sizes.orderBy(F.desc("count"), "topic").limit(n)


def representative_docs(points: DataFrame, centres: DataFrame | Centres, n: int = 3, key: str = "doc_id") -> DataFrame:
    """Ids of the documents nearest to the mean of their own topic."""
    own = points.join(checked_broadcast(centres), "topic")
    gap = F.aggregate(
        F.zip_with(F.col("embedding").cast("array<double>"), "centre", lambda a, b: (a - b) * (a - b)),
        F.lit(0.0), lambda s, x: s + x,
    )
    order = Window.partitionBy("topic").orderBy("_gap", key)
    near = own.select("topic", key, F.round(F.sqrt(gap), RANK_DIGITS).alias("_gap"))
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_n", key))), lambda s: s[key])
    return near.groupBy("topic").agg(ids.alias("representative_doc_ids"))


def topic_info(labelled: DataFrame, words: DataFrame, points: DataFrame, centres: DataFrame) -> DataFrame:
    """Topic, number of documents, name, words and representative documents.

    A topic without words has neither a name nor words.
    """
    lists = filter_empty_topics(words).groupBy("topic").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words")
    )
    name = F.concat(F.col("topic").cast("string"), F.lit("_"), F.array_join(F.slice("words", 1, 4), "_"))
    return (
        topic_sizes(labelled).join(lists, "topic", "left").join(representative_docs(points, centres), "topic", "left")
        .select("topic", "count", name.alias("name"), "words", "representative_doc_ids")
    )


def topic_embeddings(points: DataFrame, vector: str = "embedding") -> DataFrame:
    return mean_vectors(points, ["topic"], vector)


def topic_similarity(centres: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cosine of every topic with every topic (the heat map itself): ``topic_a, topic_b, similarity``."""

    def cell(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = stack(left["v"]), stack(right["v"])
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        s = a @ b.T
        ia, ib = np.repeat(left["topic"].to_numpy(), len(b)), np.tile(right["topic"].to_numpy(), len(a))
        out = pd.DataFrame({"topic_a": ia, "topic_b": ib, "similarity": s.ravel()})
        if same:
            return out
        back = pd.DataFrame({"topic_a": ib, "topic_b": ia, "similarity": s.ravel()})
        return pd.concat([out, back])

    slim = centres.select("topic", F.col("centre").cast("array<double>").alias("v"))
    return blocked_self(slim, cell, "topic_a int, topic_b int, similarity double", "topic", block_rows)


def topic_colours(labelled: DataFrame, palette: list[str] = DOCUMENT_PALETTE, default: str = OUTLIER_COLOUR) -> DataFrame:
    """Colour per row: the palette in topic order, over again when it ends; outliers get the default."""
    distinct = labelled.select("topic").where("topic <> -1").distinct()
    place = F.row_number().over(Window.orderBy("topic")) - 1
    colour = F.element_at(F.array(*[F.lit(c) for c in palette]), (place % len(palette) + 1).cast("int"))
    colours = distinct.select("topic", colour.alias("colour"))
    return labelled.join(checked_broadcast(colours), "topic", "left").withColumn(
        "colour", F.coalesce("colour", F.lit(default))
    )


def topic_centroids_2d(plot: DataFrame) -> DataFrame:
    """Mean position and length per topic."""
    return plot.groupBy("topic").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("length").alias("length"))


def scatter_data(points: DataFrame, docs: DataFrame, key: str = "doc_id", palette: list[str] = DOCUMENT_PALETTE) -> DataFrame:
    """``doc_id, x, y, topic, length, colour`` for plotting; ``points`` carries topic and embedding."""
    placed = reduce_for_plot(points).select(key, "topic", "x", "y")
    lengths = docs.select(key, F.length("text").alias("length"))
    return topic_colours(placed.join(lengths, key), palette).select(key, "x", "y", "topic", "length", "colour")


def intertopic_map(centres: DataFrame) -> DataFrame:
    """Position and size per topic."""
    return reduce_for_plot(centres, "centre").select("topic", "size", "x", "y")


def topic_barchart_data(sizes: DataFrame, words: DataFrame, n: int = 20, terms: int = 5) -> DataFrame:
    """Heaviest terms of the largest topics, outlier topic left out."""
    top = head_topics(sizes.where("topic <> -1"), n)
    return words.where(F.col("rank") <= terms).join(F.broadcast(top), "topic").select("topic", "count", "rank", "word", "score")
