"""Topic tables: weights, rankings, labels, sizes, similarity, plots and the merge tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.functions.fixed import DOCUMENT_PALETTE, OUTLIER_COLOUR, TOPIC_PALETTE
from callweave.operators import filters as fl
from callweave.operators import hierarchy as hi
from callweave.operators import topics as tp
from callweave.operators import vocab as vc
from callweave.plans.documents import text_view, view
from callweave.plans.registry import query
from callweave.plans.sqltext import STOP, TRANSCRIPTS, quoted, r6, words2
from callweave.plans.text import VOCAB, docs, seed_frame
from callweave.plans.vectors import CENTRES, E, vectors
from callweave.session import materialise, scratch_path
from callweave.sources import stores

tidy = vx.tidy

# Counts of vocabulary terms per document, then weights per topic of the transcript view.
WEIGHTS = f"""{TRANSCRIPTS}, {VOCAB},
dt AS (SELECT topic, list_filter({words2('text')}, lambda w: w NOT IN ({quoted(STOP)})) AS t FROM transcripts WHERE speakertypeid IS DISTINCT FROM 1),
g AS (SELECT topic, unnest(t) AS term FROM dt UNION ALL
  SELECT topic, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM dt),
tfc AS MATERIALIZED (SELECT topic, term, count(*) AS tf FROM g WHERE term IN (SELECT term FROM vocab) GROUP BY topic, term),
nc AS (SELECT topic, sum(tf) AS n_c FROM tfc GROUP BY topic), ft AS (SELECT term, sum(tf) AS f_t FROM tfc GROUP BY term),
av AS (SELECT floor(avg(n_c)) AS a FROM nc),
weights AS MATERIALIZED (SELECT topic, term, tf, tf / CAST(n_c AS DOUBLE) * ln(1 + a / f_t) AS score FROM tfc JOIN nc USING (topic) JOIN ft USING (term), av)"""


def top_sql(k: int) -> str:
    return f"""top AS MATERIALIZED (SELECT topic, term AS word, rank, score FROM (SELECT topic, term, score,
  CAST(row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM weights) WHERE rank <= {k})"""


def spoken(spark, sf):
    return fl.exclude_speaker(text_view(spark, sf))


def weights(spark, sf):
    vocab = vc.build_vocab(docs(spark, sf), seed_frame(spark))
    return tp.class_tfidf(vc.count_vectorize(spoken(spark, sf), vocab, STOP, by=("topic",)))


def top_words(spark, sf, k=10):
    return tp.topk_terms(weights(spark, sf), k)


@query("class_tfidf", f"WITH {WEIGHTS} SELECT topic, term, tf, {r6('score', 8)} AS score FROM weights")
def class_tfidf(spark, sf):
    return weights(spark, sf).withColumn("score", tidy(F.col("score"), 8))


@query("topk_terms_per_topic", f"WITH {WEIGHTS}, {top_sql(10)} SELECT topic, rank, word, {r6('score', 8)} AS score FROM top")
def topk_terms_per_topic(spark, sf):
    return top_words(spark, sf).withColumn("score", tidy(F.col("score"), 8))


@query("filter_empty_topics", f"""WITH {WEIGHTS}, {top_sql(10)} SELECT topic, rank, word FROM top
WHERE NOT (topic % 3 = 0) AND NOT (rank % 4 = 0)""")
def filter_empty_topics(spark, sf):
    """Topics divisible by three lose all their words, other topics every fourth."""
    gone = (F.pmod("topic", F.lit(3)) == 0) | (F.col("rank") % 4 == 0)
    blanked = top_words(spark, sf).withColumn("word", F.when(gone, "").otherwise(F.col("word")))
    return tp.filter_empty_topics(blanked).select("topic", "rank", "word")


@query("topic_word_lists", f"""WITH {WEIGHTS}, {top_sql(10)} SELECT topic, string_agg(word, '|' ORDER BY rank) AS words FROM top
WHERE topic <> -1 GROUP BY topic""")
def topic_word_lists(spark, sf):
    return tp.topic_word_lists(top_words(spark, sf)).select("topic", F.array_join("words", "|").alias("words"))


@query("topic_label", f"""WITH {WEIGHTS}, {top_sql(3)} SELECT topic, string_agg(word, ' - ' ORDER BY rank) AS label FROM top
WHERE topic <> -1 GROUP BY topic""")
def topic_label(spark, sf):
    return tp.topic_word_lists(top_words(spark, sf)).select("topic", tp.topic_label(F.col("words")).alias("label"))


@query("topic_sizes", f"""WITH {TRANSCRIPTS} SELECT topic, count(*) AS count, {r6('count(*) / CAST((SELECT count(*) FROM transcripts) AS DOUBLE)')} AS share
FROM transcripts GROUP BY topic""")
def topic_sizes(spark, sf):
    df = view(spark, sf)
    total = df.agg(F.count(F.lit(1))).scalar()
    return tp.topic_sizes(df).withColumn("share", tidy(F.col("count") / total))


@query("distinct_topics", f"""WITH {TRANSCRIPTS}, t AS (SELECT DISTINCT topic FROM transcripts)
SELECT topic, (SELECT count(*) FROM t) AS n_topics, (SELECT count(*) FROM t) > 1 AS usable FROM t""")
def distinct_topics(spark, sf):
    found = view(spark, sf).select("topic").distinct()
    n = found.agg(F.count(F.lit(1))).scalar()
    return found.select("topic", n.alias("n_topics"), (n > 1).alias("usable"))


@query("head_topics", f"""WITH {TRANSCRIPTS} SELECT topic, count(*) AS count FROM transcripts WHERE topic <= 50 GROUP BY topic
ORDER BY count DESC, topic LIMIT 20""")
def head_topics(spark, sf):
    return tp.head_topics(tp.topic_sizes(view(spark, sf).where("topic <= 50")))


# Plot positions taken from two vector entries, spread so that some fall outside the square.
PLOT = """plot AS (SELECT id AS doc_id, CASE WHEN id % 11 = 0 THEN -1 ELSE label END AS topic, v[1] * 50 AS x, v[2] * 50 AS y,
  CAST(length(text) AS DOUBLE) AS length FROM e JOIN documents ON doc_id = id)"""


def plot(spark, sf):
    v = F.col("embedding").cast("array<double>")
    df = vectors(spark, sf).join(docs(spark, sf), "doc_id")
    return df.select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("topic")).alias("topic"),
        (v[0] * 50).alias("x"), (v[1] * 50).alias("y"), F.length("text").cast("double").alias("length"),
    )


@query("plot_domain_filter", f"WITH {E}, {PLOT} SELECT doc_id, topic FROM plot WHERE topic <> -1 AND x > -10 AND x < 10 AND y > -10 AND y < 10")
def plot_domain_filter(spark, sf):
    return fl.drop_outliers_and_far(plot(spark, sf)).select("doc_id", "topic")


CENTROID = f"""SELECT topic, {r6('avg(x)')} AS x, {r6('avg(y)')} AS y, {r6('avg(length)')} AS length FROM plot
WHERE topic <> -1 AND x > -10 AND x < 10 AND y > -10 AND y < 10 GROUP BY topic"""


def centroids(spark, sf):
    df = tp.topic_centroids_2d(fl.drop_outliers_and_far(plot(spark, sf)))
    return df.select("topic", *[tidy(F.col(c)).alias(c) for c in ("x", "y", "length")])


@query("topic_centroid_2d", f"WITH {E}, {PLOT} {CENTROID}")
def topic_centroid_2d(spark, sf):
    return centroids(spark, sf)


@query("sort_topics", f"WITH {E}, {PLOT} {CENTROID} ORDER BY topic")
def sort_topics(spark, sf):
    return centroids(spark, sf).orderBy("topic")


def colour_sql(palette: list[str], default: str) -> str:
    return f"""p AS (SELECT topic, ([{quoted(palette)}])[CAST((row_number() OVER (ORDER BY topic) - 1) % {len(palette)} AS INTEGER) + 1] AS colour
  FROM (SELECT DISTINCT topic FROM transcripts WHERE topic <> -1))
SELECT doc_id, t.topic, coalesce(colour, '{default}') AS colour FROM transcripts t LEFT JOIN p ON t.topic = p.topic"""


@query("topic_colour", f"WITH {TRANSCRIPTS}, {colour_sql(DOCUMENT_PALETTE, OUTLIER_COLOUR)}")
def topic_colour(spark, sf):
    return tp.topic_colours(view(spark, sf).select("doc_id", "topic"))


@query("topic_colour_annotated", f"WITH {TRANSCRIPTS}, {colour_sql(TOPIC_PALETTE, OUTLIER_COLOUR)}")
def topic_colour_annotated(spark, sf):
    return tp.topic_colours(view(spark, sf).select("doc_id", "topic"), TOPIC_PALETTE)


@query("topic_embeddings", f"""WITH {E}, {CENTRES} SELECT topic, pos, {r6('x', 8)} AS value FROM (
  SELECT topic, unnest(centre) AS x, generate_subscripts(centre, 1) - 1 AS pos FROM c)""")
def topic_embeddings(spark, sf):
    df = tp.topic_embeddings(vectors(spark, sf)).select("topic", F.posexplode("centre").alias("pos", "value"))
    return df.select("topic", F.col("pos").cast("long").alias("pos"), tidy(F.col("value"), 8).alias("value"))


@query("topic_similarity", f"""WITH {E}, {CENTRES} SELECT a.topic AS topic_a, b.topic AS topic_b,
  {r6('list_cosine_similarity(a.centre, b.centre)')} AS similarity FROM c a, c b""")
def topic_similarity(spark, sf):
    df = tp.topic_similarity(tp.topic_embeddings(vectors(spark, sf)))
    return df.withColumn("similarity", tidy(F.col("similarity")))


@query("topic_barchart_data", f"""WITH {WEIGHTS}, {top_sql(5)}, s AS (SELECT topic, count(*) AS count FROM transcripts WHERE topic <> -1 GROUP BY topic
  ORDER BY count DESC, topic LIMIT 20)
SELECT topic, count, rank, word, {r6('score', 8)} AS score FROM top JOIN s USING (topic)""")
def topic_barchart_data(spark, sf):
    chart = tp.topic_barchart_data(tp.topic_sizes(view(spark, sf)), top_words(spark, sf, 5))
    return chart.withColumn("score", tidy(F.col("score"), 8))


@query(
    "topic_info",
    f"""WITH {WEIGHTS}, {top_sql(10)}, {E},
own AS (SELECT id AS doc_id, v, topic FROM e JOIN transcripts ON id = doc_id),
cen AS (SELECT topic, list(m ORDER BY pos) AS centre FROM (SELECT topic, pos, avg(x) AS m FROM (
  SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM own) GROUP BY topic, pos) GROUP BY topic),
rep AS (SELECT topic, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY r) AS docs FROM (SELECT topic, doc_id,
  row_number() OVER (PARTITION BY topic ORDER BY round(list_distance(v, centre), 9), doc_id) AS r FROM own JOIN cen USING (topic))
  WHERE r <= 3 GROUP BY topic),
lists AS (SELECT topic, string_agg(word, '|' ORDER BY rank) AS words,
  string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS short FROM top GROUP BY topic)
SELECT topic, n AS count, topic || '_' || short AS name, words, docs FROM (SELECT topic, count(*) AS n FROM transcripts GROUP BY topic)
LEFT JOIN lists USING (topic) LEFT JOIN rep USING (topic)""",
)
def topic_info(spark, sf):
    df = view(spark, sf).select("doc_id", "topic")
    points = vectors(spark, sf).drop("topic").join(df, "doc_id")
    info = tp.topic_info(df, top_words(spark, sf), points, tp.topic_embeddings(points).select("topic", "centre"))
    return info.select(
        "topic", "count", "name", F.array_join("words", "|").alias("words"), F.array_join("representative_doc_ids", "|").alias("docs")
    )


@query("model_store", f"""WITH {WEIGHTS}, {top_sql(10)}, {E}, {CENTRES} SELECT topic, rank, word, {r6('centre[1]', 8)} AS first_entry
FROM top JOIN c USING (topic)""")
def model_store(spark, sf):
    root = scratch_path(spark, "models")
    centres = tp.topic_embeddings(vectors(spark, sf)).select("topic", "centre")
    stores.save_model(centres, top_words(spark, sf).select("topic", "rank", "word"), root, 10)
    stored, terms = stores.load_model(spark, root, 10)
    return terms.join(stored, "topic").select("topic", "rank", "word", tidy(F.col("centre")[0], 8).alias("first_entry"))


@query("intertopic_map")
def intertopic_map(spark, sf):
    return tp.intertopic_map(tp.topic_embeddings(vectors(spark, sf)))


@query("scatter_data")
def scatter_data(spark, sf):
    return tp.scatter_data(vectors(spark, sf), docs(spark, sf))


@query(
    "topic_hierarchy_first_merge",
    f"""WITH {E}, {CENTRES}, n AS (SELECT row_number() OVER (ORDER BY topic) - 1 AS leaf, centre FROM c)
SELECT a.leaf AS "left", b.leaf AS "right", {r6('list_distance(a.centre, b.centre)')} AS distance FROM n a JOIN n b ON a.leaf < b.leaf
ORDER BY list_distance(a.centre, b.centre) LIMIT 1""",
)
def topic_hierarchy_first_merge(spark, sf):
    tree = hi.topic_hierarchy(tp.topic_embeddings(vectors(spark, sf)))
    return tree.where("step = 0").select("left", "right", tidy(F.col("distance")).alias("distance"))


@query("topic_hierarchy")
def topic_hierarchy(spark, sf):
    points = vectors(spark, sf).drop("topic").join(view(spark, sf).select("doc_id", "topic"), "doc_id")
    return hi.topic_hierarchy(materialise(tp.topic_embeddings(points), "centres"))
