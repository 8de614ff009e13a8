"""Quality scores and model selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from callweave.functions import text as tx, vectors as vx
from callweave.operators import cluster as cl
from callweave.operators import evaluate as ev
from callweave.operators import filters as fl
from callweave.operators import selection as se
from callweave.operators import topics as tp
from callweave.plans.registry import query
from callweave.plans.sqltext import STOP, r6, words2
from callweave.plans.text import docs
from callweave.plans.topics import WEIGHTS, top_sql, top_words
from callweave.plans.vectors import CENTRES, E, vectors
from callweave.session import materialise

tidy = vx.tidy


def silhouette_sql(points: str, out: str, by: str = "", power: int = 1) -> str:
    """Mean silhouette over ``points(id, v, topic)``; ``by`` names an extra model or fold column."""
    b, ab, eq = (f"{by}, ", f"a.{by}, ", f" AND a.{by} = b.{by}") if by else ("", "", "")
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""{out}_s AS (SELECT {ab}a.id, a.topic AS own, b.topic AS other, sum(power(list_distance(a.v, b.v), {power})) AS total, count(*) AS n
  FROM {points} a JOIN {points} b ON a.id <> b.id{eq} GROUP BY {ab}a.id, a.topic, b.topic),
{out}_n AS (SELECT {b}topic, count(*) AS n FROM {points} GROUP BY {b}topic),
{out}_i AS (SELECT {b}id, own, coalesce(max(total / n) FILTER (WHERE own = other), 0) AS a, min(total / n) FILTER (WHERE own <> other) AS b,
  count(*) FILTER (WHERE own = other) AS mates FROM {out}_s GROUP BY {b}id, own),
{out} AS (SELECT {head}CASE WHEN count(b) = 0 THEN -1.0 ELSE avg(CASE WHEN mates = 0 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) END
  AS silhouette FROM {out}_i{group})"""


@query("silhouette_exact", f"""WITH {E}, pts AS (SELECT id, v, label AS topic FROM e), {silhouette_sql('pts', 's')}
SELECT {r6('silhouette')} AS silhouette, (SELECT count(DISTINCT topic) FROM pts) AS clusters FROM s""")
def silhouette_exact(spark, sf):
    df = ev.silhouette_exact(vectors(spark, sf))
    return df.select(tidy(F.col("silhouette")).alias("silhouette"), F.col("clusters").cast("long").alias("clusters"))


@query("silhouette_sampled", f"""WITH {E}, pts AS (SELECT id, v, label AS topic FROM e ORDER BY md5('42:' || id) LIMIT 10000), {silhouette_sql('pts', 's')}
SELECT {r6('silhouette')} AS silhouette FROM s""")
def silhouette_sampled(spark, sf):
    return ev.silhouette_sampled(vectors(spark, sf)).select(tidy(F.col("silhouette")).alias("silhouette"))


@query("silhouette_guard", f"""WITH {E}, pts AS (SELECT id, v, 0 AS topic FROM e), {silhouette_sql('pts', 's')}
SELECT {r6('silhouette')} AS silhouette FROM s""")
def silhouette_guard(spark, sf):
    one = vectors(spark, sf).withColumn("topic", F.lit(0))
    return ev.silhouette_exact(one).select(tidy(F.col("silhouette")).alias("silhouette"))


@query("silhouette_scalable", f"""WITH {E}, pts AS (SELECT id, v, label AS topic FROM e), {silhouette_sql('pts', 's', power=2)}
SELECT (SELECT count(*) FROM pts) AS n, {r6('silhouette')} AS silhouette FROM s""")
def silhouette_scalable(spark, sf):
    df = vectors(spark, sf)
    value = ev.silhouette_scalable(df)
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", tidy(F.lit(value)))


TOKENS = f"tk AS (SELECT doc_id, {words2('text')} AS t FROM documents)"
# Every window start that an occurrence of a topic word lies in, then plain counting.
COOCCURRENCE = f"""{TOKENS}, tw AS MATERIALIZED (SELECT DISTINCT topic, word FROM top WHERE topic <> -1),
wp AS MATERIALIZED (SELECT DISTINCT a.word AS a, b.word AS b FROM tw a JOIN tw b ON a.topic = b.topic AND a.word < b.word),
oc AS MATERIALIZED (SELECT doc_id, n, p, word FROM (SELECT doc_id, len(t) AS n, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS p FROM tk)
  WHERE word IN (SELECT word FROM tw)),
cv AS MATERIALIZED (SELECT DISTINCT doc_id, word, unnest(range(greatest(0, p - 109), least(p, greatest(0, n - 110)) + 1)) AS s FROM oc),
n1 AS MATERIALIZED (SELECT word, count(*) AS n FROM cv GROUP BY word),
n2 AS MATERIALIZED (SELECT a, b, count(*) AS n FROM wp JOIN cv x ON x.word = a JOIN cv y ON y.word = b AND x.doc_id = y.doc_id AND x.s = y.s GROUP BY a, b),
nw AS (SELECT sum(greatest(1, len(t) - 109)) AS windows FROM tk)"""


def tokens(spark, sf):
    return docs(spark, sf).select("doc_id", tx.vectorizer_tokenize(F.col("text")).alias("tokens"))


@query("window_cooccurrence", f"""WITH {WEIGHTS}, {top_sql(10)}, {COOCCURRENCE}
SELECT wp.a, wp.b, coalesce(n2.n, 0) AS n, CAST((SELECT windows FROM nw) AS BIGINT) AS windows FROM wp LEFT JOIN n2 ON wp.a = n2.a AND wp.b = n2.b
UNION ALL SELECT word, word, n, CAST((SELECT windows FROM nw) AS BIGINT) FROM n1""")
def window_cooccurrence(spark, sf):
    words = materialise(top_words(spark, sf).where("topic <> -1").select("topic", "word"), "words")
    single, both, windows = ev.window_cooccurrence(tokens(spark, sf), ev.word_pairs(words, ["topic"]), words)
    rows = both.unionByName(single.select(F.col("word").alias("a"), F.col("word").alias("b"), "n"))
    return rows.withColumn("windows", windows.scalar())


@query("coherence_cv", f"""WITH {WEIGHTS}, {top_sql(10)}, {COOCCURRENCE},
pa AS (SELECT word, n / CAST((SELECT windows FROM nw) AS DOUBLE) AS p FROM n1),
pj AS (SELECT a, b, n / CAST((SELECT windows FROM nw) AS DOUBLE) AS p FROM n2 UNION ALL SELECT b, a, n / CAST((SELECT windows FROM nw) AS DOUBLE) FROM n2
  UNION ALL SELECT word, word, p FROM pa),
cell AS (SELECT x.topic, x.word AS a, y.word AS b, CASE WHEN coalesce(px.p, 0) > 0 AND coalesce(py.p, 0) > 0
  THEN ln((coalesce(pj.p, 0) + 1e-12) / (px.p * py.p)) / -ln(coalesce(pj.p, 0) + 1e-12) ELSE 0 END AS x
  FROM tw x JOIN tw y ON x.topic = y.topic LEFT JOIN pj ON pj.a = x.word AND pj.b = y.word
  LEFT JOIN pa px ON px.word = x.word LEFT JOIN pa py ON py.word = y.word),
col AS (SELECT topic, b, sum(x) AS t FROM cell GROUP BY topic, b),
cs AS (SELECT topic, a, sum(x * t) AS xt, sum(x * x) AS xx, sum(t * t) AS tt FROM cell JOIN col USING (topic, b) GROUP BY topic, a)
SELECT topic, {r6('avg(CASE WHEN xx > 0 AND tt > 0 THEN xt / sqrt(xx * tt) ELSE 0 END)')} AS coherence FROM cs GROUP BY topic""")
def coherence_cv(spark, sf):
    scores = ev.coherence_cv(tokens(spark, sf), top_words(spark, sf))
    return scores.withColumn("coherence", tidy(F.col("coherence")))


# Models with 3 to 10 centres: the means of the first k labels.
KS = list(range(3, 11))
MODELS = f"""{E}, {CENTRES}, km AS (SELECT unnest(range({KS[0]}, {KS[-1] + 1})) AS k),
pts AS MATERIALIZED (SELECT k, id, v, topic, d FROM (SELECT k, id, v, topic, list_distance(v, centre) AS d,
  row_number() OVER (PARTITION BY k, id ORDER BY round(list_distance(v, centre), 9), topic) AS r FROM km JOIN c ON topic < k, e) WHERE r = 1),
inr AS (SELECT k, sum(d * d) AS inertia FROM pts GROUP BY k)"""


def k_centres(df):
    """The models with 3 to 10 fixed centres."""
    _, matrix = cl.collect_centres(tp.topic_embeddings(df))
    return [matrix[:k] for k in KS]


def k_inertia(spark, sf):
    """Inertia of the models; the bend needs no silhouettes, which take all pairs of rows."""
    df = vectors(spark, sf)
    _, cost = cl.fit_many(df, [cl.Spec(k) for k in KS], max_iter=0, init=k_centres(df))
    return spark.createDataFrame([(k, float(c)) for k, c in zip(KS, cost)], "k int, inertia double")


def k_silhouettes(spark, sf):
    """Silhouette of the models."""
    df = vectors(spark, sf)
    scores = ev.silhouette_many(cl.label_many(df.select("doc_id", "embedding"), k_centres(df)))
    return scores.select((F.col("pos") + KS[0]).alias("k"), "silhouette")


@query("second_difference", f"""WITH {MODELS}
SELECT CAST(k AS INTEGER) AS k, {r6('inertia')} AS inertia, {r6('d2')} AS d2 FROM (SELECT k, inertia,
  lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k) AS d2 FROM inr) WHERE d2 IS NOT NULL""")
def second_difference(spark, sf):
    df = se.second_difference(k_inertia(spark, sf))
    return df.select("k", tidy(F.col("inertia")).alias("inertia"), tidy(F.col("d2")).alias("d2"))


@query("elbow_k", f"""WITH {MODELS}, dd AS (SELECT k, lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k) AS d2 FROM inr)
SELECT CAST(k AS INTEGER) AS elbow, CAST(k - 1 AS INTEGER) AS as_written FROM dd WHERE d2 IS NOT NULL ORDER BY d2 DESC, k LIMIT 1""")
def elbow_k(spark, sf):
    scores = k_inertia(spark, sf)
    return se.elbow_k(scores).withColumn("as_written", se.elbow_k(scores, literal=True).scalar())


@query("argmax_k", f"""WITH {MODELS}, {silhouette_sql('pts', 's', 'k')}
SELECT CAST(k AS INTEGER) AS k, {r6('silhouette')} AS silhouette FROM s WHERE silhouette > -1 ORDER BY s.silhouette DESC, k LIMIT 1""")
def argmax_k(spark, sf):
    return se.argmax_k(k_silhouettes(spark, sf)).select("k", tidy(F.col("silhouette")).alias("silhouette"))


FOLDS = f"""{E}, f AS (SELECT id, v, label, CAST((row_number() OVER (ORDER BY md5('42:' || id)) - 1) % 10 AS INTEGER) AS fold FROM e),
fc AS (SELECT fold, label AS topic, list(m ORDER BY pos) AS centre FROM (SELECT g.fold, label, pos, avg(x) AS m FROM (SELECT unnest(range(10)) AS fold) g
  JOIN (SELECT fold AS own, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM f) z ON z.own <> g.fold GROUP BY g.fold, label, pos) GROUP BY fold, label),
pts AS MATERIALIZED (SELECT fold, id, v, topic, d FROM (SELECT f.fold, id, v, topic, list_distance(v, centre) AS d,
  row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, centre), 9), topic) AS r FROM f JOIN fc ON f.fold = fc.fold) WHERE r = 1)"""


@query("fold_means", f"""WITH {FOLDS}, {silhouette_sql('pts', 's', 'fold')}, i AS (SELECT fold, sum(d * d) AS inertia FROM pts GROUP BY fold)
SELECT {r6('avg(silhouette)')} AS silhouette, {r6('avg(inertia)')} AS inertia FROM s JOIN i USING (fold)""")
def fold_means(spark, sf):
    """Mean scores over ten folds; the model of a fold is the label means of the other folds."""
    split = materialise(fl.kfold_split(vectors(spark, sf)), "folds")
    sums = materialise(tp.mean_vectors(split, ["fold", "topic"]), "sums").collect()  # folds x labels
    topics = sorted({r.topic for r in sums})
    models = []
    for fold in range(10):
        rows = [r for r in sums if r.fold != fold]
        models.append(np.array([
            sum(np.array(r.centre) * r.size for r in rows if r.topic == t) / sum(r.size for r in rows if r.topic == t) for t in topics
        ]))
    labelled = cl.label_many(split, models)
    own = materialise(labelled.withColumn("own", F.array(F.element_at("labels", F.col("fold") + 1))), "own")
    silhouettes = ev.silhouette_many(own, "own", group="fold").select(F.col("part").alias("fold"), "silhouette")
    scores = silhouettes.join(cl.inertia_by_fold(own, models), "fold")
    means = se.fold_means(scores, "silhouette", "inertia")
    return means.select(tidy(F.col("silhouette")).alias("silhouette"), tidy(F.col("inertia")).alias("inertia"))


@query("cross_validate")
def cross_validate(spark, sf):
    """Folds over the documents that have a vector: projection, centres, vocabulary and weights of the other folds."""
    words = se.Vocabulary(stop=tuple(STOP), max_n=2, min_tf=15)
    return se.cross_validate(tokens(spark, sf), vectors(spark, sf), k=10, vocabulary=words, unmatched="drop")


@query("k_sweep")
def k_sweep(spark, sf):
    words = se.Vocabulary(stop=tuple(STOP), max_n=2, min_tf=15)
    return se.k_sweep(tokens(spark, sf), vectors(spark, sf), list(range(10, 200, 10)), vocabulary=words, unmatched="drop")


@query("optimal_k")
def optimal_k(spark, sf):
    return se.optimal_k(vectors(spark, sf))


@query("grid_search")
def grid_search(spark, sf):
    grid = se.param_grid({"n_components": [5], "metric": ["euclidean"], "min_samples": [5, 10], "min_cluster_size": [5, 20]})
    found = se.grid_search(vectors(spark, sf).drop("topic"), grid)
    return found.select(F.to_json("params").alias("params"), "score", "best", "error")
