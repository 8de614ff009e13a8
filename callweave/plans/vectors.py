"""Vector joins, neighbours, reduction, clustering and incremental fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from callweave.functions import dates, vectors as vx
from callweave.operators import cluster as cl
from callweave.operators import density as de
from callweave.operators import descent as ds
from callweave.operators import encode as en
from callweave.operators import filters as fl
from callweave.operators import neighbours as nb
from callweave.operators import reduce as rd
from callweave.operators.topics import topic_embeddings
from callweave.plans.documents import view
from callweave.plans.registry import query, table
from callweave.plans.sqltext import TRANSCRIPTS, WORD, r6
from callweave.plans.text import docs
from callweave.session import fill_slots, materialise, scratch_path
from callweave.sources import matrices, stores
from callweave.streaming import online

tidy = vx.tidy

E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
CENTRES = """c AS (SELECT label AS topic, list(m ORDER BY pos) AS centre FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY label, pos)
  GROUP BY label)"""
NEAREST = """near AS (SELECT id, topic, d FROM (SELECT id, topic, list_distance(v, centre) AS d,
  row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, centre), 9), topic) AS r FROM e, c) WHERE r = 1)"""


def vectors(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("int").alias("topic"))
    return fill_slots(df, "doc_id")


@query(
    "scrub_vectors",
    """SELECT vec_id AS doc_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i:
  CASE WHEN (vec_id + i - 1) % 7 IN (0, 1, 2) THEN 0.0 ELSE x END)), 6) AS total FROM embeddings""",
)
def scrub_vectors(spark, sf):
    """Every seventh entry is made NaN, infinite or minus infinite, then scrubbed."""
    bad = [float("nan"), float("inf"), float("-inf")]
    spoil = lambda x, i: F.when((F.col("doc_id") + i) % 7 == 0, bad[0]).when((F.col("doc_id") + i) % 7 == 1, bad[1]).when(
        (F.col("doc_id") + i) % 7 == 2, bad[2]).otherwise(x)
    spoiled = vectors(spark, sf).withColumn("v", F.transform(F.col("embedding").cast("array<double>"), spoil))
    total = F.aggregate(vx.scrub(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return spoiled.select("doc_id", F.round(total, 6).alias("total"))


@query("join_doc_embedding", """SELECT doc_id, lang, label AS topic, len(embedding) AS dims FROM documents JOIN embeddings ON doc_id = vec_id""")
def join_doc_embedding(spark, sf):
    pair = table(spark, sf, "documents").select("doc_id", "lang").join(vectors(spark, sf), "doc_id")
    return pair.select("doc_id", "lang", "topic", F.size("embedding").cast("long").alias("dims"))


@query(
    "load_embeddings_for_docs",
    f"WITH {E} SELECT doc_id, {r6('sqrt(list_inner_product(v, v))')} AS length FROM documents JOIN e ON doc_id = id",
)
def load_embeddings_for_docs(spark, sf):
    root = scratch_path(spark, "model")
    stores.save_embeddings(vectors(spark, sf), root, "any/encoder")
    stored = stores.load_embeddings(spark, root, "any/encoder")
    kept = docs(spark, sf).select("doc_id").join(stored, "doc_id")
    return kept.select("doc_id", tidy(vx.norm(F.col("embedding").cast("array<double>"))).alias("length"))


@query(
    "pairwise_distance",
    f"""WITH {E} SELECT a.id, {r6('sum(list_distance(a.v, b.v))')} AS total, {r6('min(list_distance(a.v, b.v))')} AS low,
  {r6('max(list_distance(a.v, b.v))')} AS high, count(*) AS others FROM e a JOIN e b ON a.id <> b.id GROUP BY a.id""",
)
def pairwise_distance(spark, sf):
    df = nb.pairwise_distance(vectors(spark, sf))
    return df.select("id", *[tidy(F.col(c)).alias(c) for c in ("total", "low", "high")], "others")


def knn_sql(k: int) -> str:
    return f"""knn AS (SELECT id, neighbour, distance, rank FROM (
  SELECT id, neighbour, distance, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM (
    SELECT a.id, b.id AS neighbour, round(1 - list_cosine_similarity(a.v, b.v), 9) AS distance FROM e a JOIN e b ON a.id <> b.id))
  WHERE rank <= {k})"""


@query("knn_graph", f"WITH {E}, {knn_sql(10)} SELECT id, rank, neighbour, {r6('distance')} AS distance FROM knn")
def knn_graph(spark, sf):
    return nb.knn_graph(vectors(spark, sf), 10).withColumn("distance", tidy(F.col("distance")))


@query("knn_descent")
def knn_descent(spark, sf):
    """The neighbour graph by comparing neighbours of neighbours."""
    return ds.neighbour_descent(vectors(spark, sf), 10)


@query(
    "embedding_matrix",
    f"WITH {E} SELECT row_number() OVER (ORDER BY id) - 1 AS row_id, {r6('sqrt(list_inner_product(v, v))')} AS length, {r6('v[1]')} AS head FROM e",
)
def embedding_matrix(spark, sf):
    """Vectors written as .npy parts in the order of their ids, and read back with their row numbers."""
    path = scratch_path(spark, "matrix")
    matrices.save_matrix(vectors(spark, sf), path, part_rows=200)
    stored = matrices.load_matrix(spark, path, split_bytes=64 << 10)
    return stored.select("row_id", tidy(vx.norm(F.col("embedding"))).alias("length"), tidy(F.col("embedding")[0]).alias("head"))


@query(
    "fuzzy_knn_graph",
    f"""WITH RECURSIVE {E}, {knn_sql(10)},
p AS (SELECT id, list(distance ORDER BY rank) AS d, min(distance) AS rho FROM knn GROUP BY id),
s AS (SELECT id, d, rho, CAST(0.0 AS DOUBLE) AS lo, CAST(1024.0 AS DOUBLE) AS hi, 0 AS step FROM p
  UNION ALL
  SELECT id, d, rho,
    CASE WHEN list_sum(list_transform(d, lambda x: exp(-greatest(0.0, x - rho) / ((lo + hi) / 2)))) > log2(10) THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN list_sum(list_transform(d, lambda x: exp(-greatest(0.0, x - rho) / ((lo + hi) / 2)))) > log2(10) THEN (lo + hi) / 2 ELSE hi END,
    step + 1 FROM s WHERE step < 64),
w AS (SELECT k.id, k.neighbour, exp(-greatest(0.0, k.distance - s.rho) / ((lo + hi) / 2)) AS w
  FROM knn k JOIN s ON k.id = s.id AND s.step = 64)
SELECT a, b, {r6('sum(w) - CASE WHEN count(*) = 2 THEN product(w) ELSE 0 END')} AS weight
FROM (SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, w FROM w) GROUP BY a, b""",
)
def fuzzy_knn_graph(spark, sf):
    graph = nb.fuzzy_knn_graph(nb.knn_graph(vectors(spark, sf), 10), 10)
    return graph.withColumn("weight", tidy(F.col("weight")))


@query(
    "embed_documents",
    f"""WITH t AS (SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents) GROUP BY ALL),
h AS (SELECT term, md5(term) AS h FROM (SELECT DISTINCT term FROM t)),
s AS (SELECT term, i AS pos, CASE WHEN (CAST('0x' || substr(h, CAST(i // 4 AS INTEGER) + 1, 1) AS INTEGER) >> CAST(3 - i % 4 AS INTEGER)) & 1 = 1
  THEN 1 ELSE -1 END AS sign FROM h, range(0, 64) AS r(i)),
v AS (SELECT doc_id, pos, CAST(sum(n * sign) AS DOUBLE) AS x FROM t JOIN s USING (term) GROUP BY doc_id, pos),
l AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM v GROUP BY doc_id)
SELECT d.doc_id, p.pos, coalesce({r6('CASE WHEN len > 0 THEN x / len ELSE 0 END', 4)}, 0.0) AS value
FROM documents d CROSS JOIN range(0, 64) AS p(pos) LEFT JOIN v ON v.doc_id = d.doc_id AND v.pos = p.pos LEFT JOIN l ON l.doc_id = d.doc_id""",
)
def embed_documents(spark, sf):
    made = en.embed_documents(docs(spark, sf), en.HashedEncoder(64))
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), tidy(F.col("value").cast("double"), 4).alias("value")
    )


@query(
    "pca_moments",
    f"""WITH {E}, x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {r6('covar_samp(a.x, b.x)', 8)} AS value
FROM x a JOIN x b USING (id) GROUP BY a.i, b.i""",
)
def pca_moments(spark, sf):
    """Two batches, merged, as the incremental reduction does."""
    df = vectors(spark, sf)
    parts = [rd.moments(df.where(F.col("topic") % 2 == r)) for r in (0, 1)]
    cov = rd.covariance(rd.merge_moments(*parts))
    return cov.select("i", "j", tidy(F.col("value"), 8).alias("value"))


@query("pca_reduce")
def pca_reduce(spark, sf):
    return rd.pca_reduce(vectors(spark, sf), 5).select("doc_id", "reduced")


@query(
    "pca_rotation",
    f"""WITH {E}, m AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM (
  SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos))
SELECT id AS doc_id, {r6('list_distance(v, mean)')} AS length FROM e, m""",
)
def pca_rotation(spark, sf):
    """All components of a row are as long as the row is far from the mean: the axes are a rotation."""
    df = vectors(spark, sf)
    width = df.select(F.max(F.size("embedding"))).scalar()
    size = spark.range(1).select(width.alias("n")).first().n
    return rd.pca_reduce(df, size).select("doc_id", tidy(vx.norm(F.col("reduced"))).alias("length"))


@query("reduce_for_plot")
def reduce_for_plot(spark, sf):
    return rd.reduce_for_plot(vectors(spark, sf)).select("doc_id", "x", "y")


@query("kmeans_topics")
def kmeans_topics(spark, sf):
    _, labelled = cl.kmeans_topics(vectors(spark, sf).drop("topic"), k=100)
    return labelled.select("doc_id", "topic")


@query("assign_topics", f"WITH {E}, {CENTRES}, {NEAREST} SELECT id AS doc_id, topic, {r6('d')} AS distance FROM near")
def assign_topics(spark, sf):
    df = vectors(spark, sf)
    near = cl.assign_topics(df, topic_embeddings(df))
    return near.select("doc_id", "topic", tidy(F.col("distance")).alias("distance"))


@query("inertia", f"WITH {E}, {CENTRES}, {NEAREST} SELECT {r6('sum(d * d)')} AS inertia, count(*) AS n FROM near")
def inertia(spark, sf):
    df = vectors(spark, sf)
    return cl.inertia(df, topic_embeddings(df)).select(tidy(F.col("inertia")).alias("inertia"), "n")


@query(
    "topic_probabilities",
    f"""WITH {E}, {CENTRES}, x AS (SELECT id, topic, exp(list_cosine_similarity(v, centre)) AS e FROM e, c)
SELECT id AS doc_id, topic, {r6('e / sum(e) OVER (PARTITION BY id)')} AS probability FROM x""",
)
def topic_probabilities(spark, sf):
    df = vectors(spark, sf)
    return cl.topic_probabilities(df, topic_embeddings(df)).withColumn("probability", tidy(F.col("probability")))


def lloyd_sql(steps: int) -> str:
    """CTEs for fixed-start k-means; the start is each label's vector with the smallest id."""
    parts = ["c0 AS (SELECT label AS topic, arg_min(v, id) AS centre FROM e GROUP BY label)"]
    for s in range(steps + 1):
        parts.append(
            f"""a{s} AS MATERIALIZED (SELECT id, v, topic, d FROM (SELECT id, v, topic, list_distance(v, centre) AS d,
  row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, centre), 9), topic) AS r FROM e, c{s}) WHERE r = 1)"""
        )
        if s < steps:
            parts.append(
                f"""c{s + 1} AS MATERIALIZED (SELECT c.topic, coalesce(n.centre, c.centre) AS centre FROM c{s} c LEFT JOIN (
  SELECT topic, list(m ORDER BY pos) AS centre FROM (SELECT topic, pos, avg(x) AS m FROM (
    SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{s}) GROUP BY topic, pos) GROUP BY topic) n USING (topic))"""
            )
    return ", ".join(parts)


@query("kmeans_fixed_init", f"WITH {E}, {lloyd_sql(2)} SELECT id AS doc_id, topic, {r6('d')} AS distance FROM a2")
def kmeans_fixed_init(spark, sf):
    df = vectors(spark, sf)
    start = df.groupBy("topic").agg(F.min_by("embedding", "doc_id").alias("centre"))
    model = cl.kmeans_fixed_init(df, start, 2)
    return cl.assign_topics(df, model).select("doc_id", "topic", tidy(F.col("distance")).alias("distance"))


MINI_BATCHES, MINI_EPOCHS = 4, 2


def minibatch_sql() -> str:
    """The fit by small steps, unrolled; the start is each label's vector with the smallest id."""
    parts = [
        f"b AS MATERIALIZED (SELECT id, v, ('0x' || substr(md5('0:' || id), 1, 12))::BIGINT % {MINI_BATCHES} AS batch FROM e)",
        "c0 AS (SELECT label AS topic, arg_min(v, id) AS centre, CAST(0 AS DOUBLE) AS n FROM e GROUP BY label)",
    ]
    near = """SELECT id, v, topic, d FROM (SELECT id, v, topic, list_distance(v, centre) AS d,
  row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, centre), 9), topic) AS r FROM {rows}, {c}) WHERE r = 1"""
    steps = MINI_BATCHES * MINI_EPOCHS
    for s in range(steps):
        rows = f"(SELECT * FROM b WHERE batch = {s % MINI_BATCHES})"
        parts.append(
            f"""s{s} AS MATERIALIZED (SELECT topic, list(x ORDER BY pos) AS total, max(m) AS m FROM (SELECT topic, pos, sum(x) AS x, count(*) AS m
  FROM (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ({near.format(rows=rows, c=f'c{s}')})) GROUP BY topic, pos) GROUP BY topic)"""
        )
        parts.append(
            f"""c{s + 1} AS MATERIALIZED (SELECT c.topic, CASE WHEN s.m IS NULL THEN c.centre ELSE
  list_transform(c.centre, lambda x, i: x + (s.total[i] - s.m * x) / (c.n + s.m)) END AS centre, c.n + coalesce(s.m, 0) AS n FROM c{s} c LEFT JOIN s{s} s USING (topic))"""
        )
    return f"{', '.join(parts)}, last AS ({near.format(rows='b', c=f'c{steps}')})"


@query("kmeans_minibatch", f"WITH {E}, {minibatch_sql()} SELECT id AS doc_id, topic, {r6('d')} AS distance FROM last")
def kmeans_minibatch(spark, sf):
    """Centres by small steps from a given start, and the rows' nearest ones."""
    df = vectors(spark, sf)
    ids, matrix = cl.collect_centres(df.groupBy("topic").agg(F.min_by("embedding", "doc_id").alias("centre")))
    centres, _ = cl.fit_minibatch(df, [cl.Spec(len(ids))], batches=MINI_BATCHES, epochs=MINI_EPOCHS, init=[matrix])
    return cl.assign_topics(df, (ids, centres[0])).select("doc_id", "topic", tidy(F.col("distance")).alias("distance"))


@query(
    "density_topics",
    f"""WITH RECURSIVE {E},
pair AS MATERIALIZED (SELECT a.id, b.id AS other, round(list_distance(a.v, b.v), 9) AS d FROM e a JOIN e b ON a.id <> b.id),
core AS MATERIALIZED (SELECT id, d AS core FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM pair) WHERE r = 5),
eps AS (SELECT quantile_disc(core, 0.5) AS eps FROM core),
dense AS (SELECT id FROM core, eps WHERE core <= eps),
link AS MATERIALIZED (SELECT p.id, p.other FROM pair p, eps WHERE d <= eps AND p.id IN (SELECT id FROM dense) AND p.other IN (SELECT id FROM dense)),
walk AS (SELECT id, id AS root FROM dense UNION SELECT l.other, w.root FROM walk w JOIN link l ON w.id = l.id WHERE w.root < l.other),
member AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
big AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS topic FROM (SELECT root FROM member GROUP BY root HAVING count(*) >= 5))
SELECT e.id AS doc_id, CAST(coalesce(big.topic, -1) AS INTEGER) AS topic
FROM e LEFT JOIN member ON e.id = member.id LEFT JOIN big ON big.root = member.root""",
)
def density_topics(spark, sf):
    return de.density_topics(vectors(spark, sf), min_samples=5, min_cluster_size=5)


ONLINE_K = 5


def online_points(spark, sf):
    when = view(spark, sf).select("doc_id", F.year("created_at").alias("year"), dates.year_quarter(F.col("created_at")).alias("yearq"))
    return vectors(spark, sf).drop("topic").join(fl.year_range(when), "doc_id").select("doc_id", "yearq", "embedding")


YEARS = list(range(2010, 2023))
QUARTERS = [y * 10 + q for y in YEARS for q in (1, 2, 3, 4)]


def online_sql(period: str, codes: list[int], name: str, grown: bool = False) -> str:
    """The incremental fit unrolled over integer period codes; the start is given: the vectors with the least ids.

    ``grown``: there is no given start, every period adds its vectors with the least ids until there are enough centres.
    """
    parts = [
        f"""q AS MATERIALIZED (SELECT id, v, {period} AS y FROM e JOIN transcripts ON doc_id = id
  WHERE year(created_at) BETWEEN {YEARS[0]} AND {YEARS[-1]})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS topic, v AS centre, CAST(0 AS DOUBLE) AS n
  FROM (SELECT id, v FROM q ORDER BY id LIMIT {ONLINE_K}))""",
    ]
    if grown:
        parts[1] = "c0 AS (SELECT CAST(0 AS BIGINT) AS topic, CAST([] AS DOUBLE[]) AS centre, CAST(0 AS DOUBLE) AS n WHERE false)"
    assign = """SELECT id, v, topic FROM (SELECT id, v, topic, row_number() OVER (PARTITION BY id
  ORDER BY round(list_distance(v, centre), 9), topic) AS r FROM q, {c} WHERE y = {y}) WHERE r = 1"""
    rows = []
    for at, y in enumerate(codes, 1):
        before = f"g{at}" if grown else f"c{at - 1}"
        if grown:
            parts.append(
                f"""g{at} AS MATERIALIZED (SELECT * FROM c{at - 1} UNION ALL SELECT have + r - 1, v, CAST(0 AS DOUBLE) FROM (
  SELECT v, row_number() OVER (ORDER BY id) AS r, (SELECT count(*) FROM c{at - 1}) AS have FROM q WHERE y = {y}) WHERE have + r <= {ONLINE_K})"""
            )
        parts.append(
            f"""s{at} AS MATERIALIZED (SELECT topic, list(x ORDER BY pos) AS total, max(m) AS m FROM (SELECT topic, pos, sum(x) AS x, count(*) AS m
  FROM (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ({assign.format(c=before, y=y)})) GROUP BY topic, pos) GROUP BY topic)"""
        )
        parts.append(
            f"""c{at} AS MATERIALIZED (SELECT c.topic, CASE WHEN s.m IS NULL THEN c.centre ELSE
  list_transform(c.centre, lambda x, i: (c.n * x + s.total[i]) / (c.n + s.m)) END AS centre, c.n + coalesce(s.m, 0) AS n
  FROM {before} c LEFT JOIN s{at} s USING (topic))"""
        )
        rows.append(f"SELECT id AS doc_id, {y} AS {name}, CAST(topic AS INTEGER) AS topic FROM ({assign.format(c=f'c{at}', y=y)})")
    fitted = " UNION ALL ".join(rows)
    return f"{', '.join(parts)}, fitted AS MATERIALIZED ({fitted})"


def online_start(df):
    """The given start of the fits that are compared with SQL."""
    rows = df.select("doc_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("doc_id").limit(ONLINE_K).collect()
    return np.array([r.v for r in rows])


@query("online_fit", f"WITH {E}, {TRANSCRIPTS}, {online_sql('year(created_at) * 10 + quarter(created_at)', QUARTERS, 'yearq', grown=True)} SELECT * FROM fitted")
def online_fit(spark, sf):
    """Quarter by quarter over the whole table, without a given start; the quarter is shown as year and digit."""
    df = materialise(online_points(spark, sf), "quarters")
    fitted = online.online_fit(df, "yearq", ONLINE_K, grow="least")
    return fitted.select("doc_id", F.replace("yearq", F.lit("Q"), F.lit("")).cast("int").alias("yearq"), "topic")


@query("online_fit_yearly", f"WITH {E}, {TRANSCRIPTS}, {online_sql('year(created_at)', YEARS, 'year')} SELECT * FROM fitted")
def online_fit_yearly(spark, sf):
    """The same fit with years as periods."""
    df = online_points(spark, sf).select("doc_id", F.substring("yearq", 1, 4).alias("period"), "embedding")
    df = materialise(df, "years")
    fitted = online.online_fit(df, "period", ONLINE_K, start=online_start(df))
    return fitted.select("doc_id", F.col("period").cast("int").alias("year"), "topic")


@query("online_fit_stream", f"WITH {E}, {TRANSCRIPTS}, {online_sql('year(created_at)', YEARS, 'year')} SELECT * FROM fitted")
def online_fit_stream(spark, sf):
    """Stream form: one year a trigger, state in the shared folder."""
    root = scratch_path(spark, "stream")
    df = online_points(spark, sf).select("doc_id", "embedding", F.substring("yearq", 1, 4).cast("int").alias("year"))
    online.publish_periods(df, "year", root)
    fitted = online.online_fit_stream(spark, root, "year", df.schema, ONLINE_K, start=online_start(df))
    return fitted.select("doc_id", "year", "topic")


@query("online_fit_reduced")
def online_fit_reduced(spark, sf):
    """Quarter by quarter on the five leading components of all rows so far; the start is drawn from the whole first quarter."""
    return online.online_fit(online_points(spark, sf), "yearq", ONLINE_K, n_components=5)


@query(
    "online_topics_stream",
    f"""WITH {E}, {TRANSCRIPTS}, {online_sql('year(created_at)', YEARS, 'year')},
ages AS (SELECT year, row_number() OVER (ORDER BY year DESC) - 1 AS age FROM (SELECT DISTINCT year FROM fitted)),
t AS (SELECT year, f.topic, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM fitted f JOIN transcripts USING (doc_id))
SELECT topic, term, round(sum(power(0.99, age)), 6) AS weight FROM t JOIN ages USING (year) GROUP BY topic, term""",
)
def online_topics_stream(spark, sf):
    """Term weights fed by the topics that the same step of the stream fits."""
    root = scratch_path(spark, "topics")
    texts = view(spark, sf).select("doc_id", "text")
    df = online_points(spark, sf).join(texts, "doc_id").select("doc_id", "embedding", "text", F.substring("yearq", 1, 4).cast("int").alias("year"))
    online.publish_periods(df, "year", root)
    _, weights = online.online_topics_stream(spark, root, "year", df.schema, ONLINE_K, start=online_start(df))
    return weights.select("topic", "term", F.round("weight", 6).alias("weight"))


@query(
    "online_bow_decay_stream",
    f"""WITH {TRANSCRIPTS}, q AS (SELECT year(created_at) AS y, topic, text FROM transcripts WHERE year(created_at) BETWEEN 2010 AND 2022),
ages AS (SELECT y, row_number() OVER (ORDER BY y DESC) - 1 AS age FROM (SELECT DISTINCT y FROM q)),
t AS (SELECT y, topic, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM q)
SELECT topic, term, round(sum(power(0.99, age)), 6) AS weight FROM t JOIN ages USING (y) GROUP BY topic, term""",
)
def online_bow_decay_stream(spark, sf):
    root = scratch_path(spark, "decay")
    df = fl.year_range(view(spark, sf).select("doc_id", "topic", "text", F.year("created_at").alias("year")))
    online.publish_periods(df, "year", root)
    weights = online.decayed_weights_stream(spark, root, "year", df.schema)
    return weights.select("topic", "term", F.round("weight", 6).alias("weight"))
