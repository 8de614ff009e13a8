"""Incremental fitting: projection, centres and decayed term weights, period by period.

The batch form walks the periods in order; the stream form does the same in ``foreachBatch``. State
is a few small tables per step in the shared folder, named after the batch, so a batch that is replayed
after a failure finds its predecessor's state and writes the same result again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import vectors as vx
from callweave.operators.cluster import Spec, _draw, _partial_sums, initial_centres
from callweave.operators.matrix import nearest, stack
from callweave.operators.reduce import Moments, Projection, collect_moments, moments
from callweave.operators.vocab import document_terms
from callweave.session import MODEL_BYTES, fill_slots, scratch_path
from callweave.sources.stores import path_exists
from callweave.sources.transcripts import ingest

CENTRES_SCHEMA = "topic int, n double, centre array<double>"
MOMENTS_SCHEMA = "i int, n double, total double, products array<double>"
DECAYS = "seq long, decay double"


@dataclass(frozen=True)
class State:
    """What a step hands to the next: centres with their weights and, if rows are reduced, the moments of all rows so far."""

    centres: np.ndarray | None = None
    n: np.ndarray | None = None
    seen: Moments | None = None
    lens: Projection | None = None

    @classmethod
    def given(cls, start: np.ndarray | None) -> State:
        """Given centres, in the space of the vectors, at weight zero."""
        return cls() if start is None else cls(np.asarray(start, float), np.zeros(len(start)))


def take_in(batch: DataFrame, state: State, n_components: int, vector: str = "embedding") -> State:
    """The state under the projection of all rows up to this batch.

    The batch's moments are added to those so far; the axes of the sum are the new basis. Centres keep their place in the space of the
    vectors: what the old coordinates stood for is expressed in the new ones.
    """
    seen = collect_moments(moments(batch, vector))
    seen = seen if state.seen is None else state.seen + seen
    lens = seen.projection(n_components)
    centres = state.centres
    if centres is not None:
        centres = lens.apply(state.lens.restore(centres) if state.lens else centres)
    return replace(state, centres=centres, seen=seen, lens=lens)


def update_centres(batch: DataFrame, state: State, alpha: float = 1.0, vector: str = "embedding") -> State:
    """Centres and weights after a batch: ``c' = (alpha n c + sum x) / (alpha n + m)``."""
    centres, n = state.centres, state.n
    lens = {None: state.lens} if state.lens else None
    sums = (
        _partial_sums(batch, [centres], [Spec(len(centres))], vector, None, lens).groupBy("cluster")
        .agg(F.sum("n").alias("m"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).collect()
    )
    new_c, new_n = centres.copy(), alpha * n
    for r in sums:
        new_n[r.cluster] = alpha * n[r.cluster] + r.m
        new_c[r.cluster] = (alpha * n[r.cluster] * centres[r.cluster] + np.array(r.total)) / new_n[r.cluster]
    return replace(state, centres=new_c, n=new_n)


def grow_centres(batch: DataFrame, state: State, k: int, vector: str = "embedding") -> State:
    """Fill up to ``k`` centres at weight zero, from all rows of the batch.

    The first ones are a k-means start over the batch; where that had fewer than ``k`` different vectors, later batches add vectors that are
    drawn with a chance proportional to their squared distance to the centres there are.
    """
    lens = {None: state.lens} if state.lens else None
    if state.centres is None or not len(state.centres):
        centres = initial_centres(batch, [Spec(k)], vector, None, lens=lens)[0]
        return replace(state, centres=centres, n=np.zeros(len(centres)))
    have = len(state.centres)
    if have >= k:
        return state
    clean = vx.scrub(F.col(vector)) if lens else F.col(vector).cast("array<double>")
    hashed = batch.select(F.lit(-1).alias("part"), F.xxhash64(vector).alias("h"), clean.alias("v"))
    drawn = _draw(hashed, {None: state.centres}, {None: k - have}, have, lens)[None]
    if not drawn:
        return state
    return replace(state, centres=np.vstack([state.centres, *drawn]), n=np.r_[state.n, np.zeros(len(drawn))])


def grow_by_least(batch: DataFrame, state: State, k: int, vector: str = "embedding", key: str = "doc_id") -> State:
    """Fill up to ``k`` centres at weight zero with the batch's vectors of the least ids."""
    have = 0 if state.centres is None else len(state.centres)
    if have >= k:
        return state
    clean = vx.scrub(F.col(vector)) if state.lens else F.col(vector).cast("array<double>")
    rows = batch.select(key, clean.alias("v")).orderBy(key).limit(k - have).collect()  # at most k rows
    first = np.array([r.v for r in rows])
    first = state.lens.apply(first) if state.lens else first
    if not have:
        return replace(state, centres=first, n=np.zeros(len(first)))
    return replace(state, centres=np.vstack([state.centres, first]), n=np.r_[state.n, np.zeros(len(first))])


def step(
    batch: DataFrame, state: State, k: int, alpha: float = 1.0, vector: str = "embedding", n_components: int | None = None,
    grow: str = "drawn", key: str = "doc_id",
) -> State:
    """One period: the projection takes in its rows, missing centres are added, all centres move."""
    if grow not in ("drawn", "least"):
        raise ValueError("grow is drawn or least")
    if batch.isEmpty():
        return state
    if n_components:
        state = take_in(batch, state, n_components, vector)
    grown = grow_by_least(batch, state, k, vector, key) if grow == "least" else grow_centres(batch, state, k, vector)
    return update_centres(batch, grown, alpha, vector)


def assign(rows: DataFrame, models: dict[str, State], period: str, vector: str = "embedding") -> DataFrame:
    """``rows`` with the topic that the centres at the end of their own period give them."""

    @F.pandas_udf("int")
    def place(v: pd.Series, p: pd.Series) -> pd.Series:
        out = pd.Series(-1, index=v.index, dtype="int32")
        for name, some in v.groupby(p):
            state = models[name]
            x = stack(some)
            out[some.index] = nearest(state.lens.apply(x) if state.lens else x, state.centres)[0].astype("int32")
        return out

    clean = vx.scrub(F.col(vector)) if any(m.lens for m in models.values()) else F.col(vector).cast("array<double>")
    return rows.withColumn("topic", place(clean, F.col(period).cast("string")))


def online_fit(
    points: DataFrame, period: str, k: int = 50, alpha: float = 1.0, key: str = "doc_id", vector: str = "embedding",
    n_components: int | None = None, start: np.ndarray | None = None, grow: str = "drawn",
) -> DataFrame:
    """Per period in order: update projection and centres, then assign the period's rows: ``key, period, topic``.

    With ``n_components`` rows are clustered by their leading components, whose basis follows all rows so far. The start is ``start``, or drawn from all
    rows of the first period; with ``grow`` of ``least`` every period adds its vectors of the least ids until there are ``k``. The rows are stored in one folder a period, so a step reads its own folder only. All rows are assigned in one last
    pass with the state their period ended with. Rows without a period belong to no step and are left out.
    """
    slim = points.where(F.col(period).isNotNull()).select(key, period, F.col(vector).cast("array<double>").alias(vector))
    path = scratch_path(points.sparkSession, "periods")
    ingest(slim, path, period)
    stored = points.sparkSession.read.schema(slim.schema).parquet(path)
    periods = [r[0] for r in stored.select(period).distinct().orderBy(period).collect()]
    state, history = State.given(start), {}
    for p in periods:
        state = step(stored.where(F.col(period) == p), state, k, alpha, vector, n_components, grow, key)
        history[str(p)] = replace(state, seen=None)
    size = max([1, *(s.centres.nbytes + (s.lens.axes.nbytes if s.lens else 0) for s in history.values())])
    per_pass = max(1, MODEL_BYTES // size)
    result = None
    for at in range(0, len(periods), per_pass):
        some = periods[at : at + per_pass]
        rows = stored.where(F.col(period).isin(some)) if len(some) < len(periods) else stored
        part = assign(rows, {str(p): history[str(p)] for p in some}, period, vector).select(key, period, "topic")
        result = part if result is None else result.unionByName(part)
    return stored.select(key, period, F.lit(None).cast("int").alias("topic")) if result is None else result


def _read_state(spark: SparkSession, root: str, name: str, batch_id: int, schema: str) -> DataFrame | None:
    """State after ``batch_id``; none before the first step. A state that should be there and is not stops the run."""
    if batch_id < 0:
        return None
    path = f"{root}/{name}/batch={batch_id}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"the state of step {batch_id} is missing: {path}")
    return spark.read.schema(schema).parquet(path)


def load_state(spark: SparkSession, root: str, batch_id: int, n_components: int | None) -> State:
    centres = _read_state(spark, root, "centres", batch_id, CENTRES_SCHEMA)
    if centres is None:
        return State()
    rows = centres.orderBy("topic").collect()  # at most k rows
    state = State(np.array([r.centre for r in rows]), np.array([r.n for r in rows])) if rows else State()
    if n_components:
        seen = _read_state(spark, root, "moments", batch_id, MOMENTS_SCHEMA)
        if not seen.isEmpty():
            held = collect_moments(seen)
            state = replace(state, seen=held, lens=held.projection(n_components))
    return state


def save_state(spark: SparkSession, root: str, batch_id: int, state: State) -> None:
    rows = [] if state.centres is None else [(i, float(n), c.tolist()) for i, (n, c) in enumerate(zip(state.n, state.centres))]
    spark.createDataFrame(rows, CENTRES_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/centres/batch={batch_id}")
    held = state.seen
    sums = [] if held is None else [(i, float(held.n), float(t), p.tolist()) for i, (t, p) in enumerate(zip(held.total, held.products))]
    spark.createDataFrame(sums, MOMENTS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/moments/batch={batch_id}")


def fit_batch(
    batch: DataFrame, batch_id: int, root: str, k: int, alpha: float = 1.0, vector: str = "embedding", n_components: int | None = None,
    start: np.ndarray | None = None,
) -> DataFrame:
    """One step of the stream form: state of the step before, update, own state, own topics. Returns the rows with their topics, as stored."""
    spark = batch.sparkSession
    state = State.given(start) if batch_id == 0 else load_state(spark, root, batch_id - 1, n_components)
    state = step(batch, state, k, alpha, vector, n_components)
    save_state(spark, root, batch_id, state)
    path = f"{root}/topics/batch={batch_id}"
    assigned = batch.withColumn("_all", F.lit("all"))
    assigned = assign(assigned, {"all": replace(state, seen=None)}, "_all", vector).drop("_all", vector)
    assigned.write.mode("overwrite").parquet(path)
    return spark.read.schema(assigned.schema).parquet(path)


def decay_batch(
    batch: DataFrame, batch_id: int, root: str, decay: float = 0.01, stop: list[str] = (), topic: str = "topic", text: str = "text",
    least: float = 0.0, vocab: DataFrame | None = None,
) -> None:
    """One step of the decayed term weights: old weights shrink, the batch's counts are added, and terms of less weight than ``least`` are forgotten.

    State is keyed by topic and term. With ``vocab`` (a column ``term``) other terms are not counted. Where nothing is forgotten, a step stores
    its own counts only, and :func:`last_weights` lets each of them shrink by the steps after it; so a step costs no more than its rows.
    """
    spark = batch.sparkSession
    schema = f"{topic} int, term string, weight double"
    whole = least > 0
    before = _read_state(spark, root, "weights" if whole else "decays", batch_id - 1, schema if whole else DECAYS)
    terms = document_terms(fill_slots(batch), list(stop), text, 1, keep=(topic,))
    if vocab is not None:
        terms = terms.join(vocab.select("term"), "term", "left_semi")
    counts = terms.groupBy(topic, "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if not whole:
        counts.write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")
        spark.createDataFrame([(batch_id, float(decay))], DECAYS).coalesce(1).write.mode("overwrite").parquet(f"{root}/decays/batch={batch_id}")
        return
    if before is not None:
        old = before.withColumn("weight", F.col("weight") * F.lit(1.0 - decay))
        counts = old.unionByName(counts).groupBy(topic, "term").agg(F.sum("weight").alias("weight"))
    counts.where(F.col("weight") >= least).write.mode("overwrite").parquet(f"{root}/weights/batch={batch_id}")


ANNOUNCED = "seq long, period string"


def publish_periods(df: DataFrame, period: str, root: str) -> None:
    """Store rows by period, then announce the periods in order, one small file each.

    Rows of a large period are written by many tasks; the announcements alone drive the stream. Each has its number: step ``n`` takes the
    period announced as ``n``, whatever the times of the files.
    """
    spark = df.sparkSession
    ingest(df, f"{root}/rows", period)
    known = spark.read.schema(ANNOUNCED).parquet(f"{root}/periods").count() if path_exists(spark, f"{root}/periods") else 0
    for n, row in enumerate(df.select(period).where(F.col(period).isNotNull()).distinct().orderBy(period).collect(), known):
        spark.createDataFrame([(n, str(row[0]))], ANNOUNCED).coalesce(1).write.mode("append").parquet(f"{root}/periods")


def period_stream(spark: SparkSession, root: str) -> DataFrame:
    """Stream of announced periods, one per trigger."""
    return spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", 1).parquet(f"{root}/periods")


def run_stream(spark: SparkSession, root: str, period: str, schema, step, name: str) -> None:
    """Run ``step(rows of the period, batch_id)`` for every period announced so far.

    The rows are read from the stored table as an ordinary parallel scan of one partition folder.
    """
    stored = spark.read.schema(schema).parquet(f"{root}/rows")

    def run(batch: DataFrame, batch_id: int) -> None:
        due = spark.read.schema(ANNOUNCED).parquet(f"{root}/periods").where(F.col("seq") == batch_id).select("period").collect()
        if len(due) != 1:
            raise ValueError(f"step {batch_id} needs exactly one announced period, not {len(due)}")
        step(stored.where(F.col(period) == due[0].period), batch_id)

    query = (
        period_stream(spark, root).writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/checkpoint-{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def online_fit_stream(
    spark: SparkSession, root: str, period: str, schema, k: int, alpha: float = 1.0, vector: str = "embedding", n_components: int | None = None,
    start: np.ndarray | None = None,
) -> DataFrame:
    """Stream form of :func:`online_fit`; returns the topics written so far."""
    run_stream(spark, root, period, schema, lambda rows, i: fit_batch(rows, i, root, k, alpha, vector, n_components, start), "fit")
    return spark.read.parquet(f"{root}/topics").drop("batch")


def last_weights(spark: SparkSession, root: str) -> DataFrame:
    """The weights after the last period."""
    if path_exists(spark, f"{root}/decays"):
        counts = spark.read.parquet(f"{root}/counts")
        factor, factors = 1.0, []
        for r in spark.read.schema(DECAYS).parquet(f"{root}/decays").select("seq", "decay").orderBy(F.col("seq").desc()).collect():  # one row a step
            factors.append((r.seq, factor))
            factor *= 1.0 - r.decay
        shrunk = counts.join(F.broadcast(spark.createDataFrame(factors, "batch long, _factor double")), "batch")
        keys = [c for c in counts.columns if c not in ("batch", "weight")]
        return shrunk.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("_factor")).alias("weight"))
    states = spark.read.parquet(f"{root}/weights")
    last = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == last).drop("batch")


def decayed_weights_stream(
    spark: SparkSession, root: str, period: str, schema, decay: float = 0.01, stop: list[str] = (), least: float = 0.0, vocab: DataFrame | None = None
) -> DataFrame:
    """Stream form of the decayed term weights for rows that have a topic; returns the weights after the last period."""
    run_stream(spark, root, period, schema, lambda rows, i: decay_batch(rows, i, root, decay, stop, least=least, vocab=vocab), "decay")
    return last_weights(spark, root)


def online_topics_stream(
    spark: SparkSession, root: str, period: str, schema, k: int, alpha: float = 1.0, vector: str = "embedding", n_components: int | None = None,
    start: np.ndarray | None = None, decay: float = 0.01, stop: list[str] = (), least: float = 0.0, vocab: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One stream for both: each step fits, assigns its rows and feeds their terms, under the topics of the same step, into the decayed weights.

    Rows carry a vector and a ``text``. Returns the topics of all rows so far and the weights after the last period. A replayed step finds the state
    of the one before and writes the same topics and weights again.
    """

    def both(rows: DataFrame, i: int) -> None:
        assigned = fit_batch(rows, i, root, k, alpha, vector, n_components, start)
        decay_batch(assigned, i, root, decay, stop, least=least, vocab=vocab)

    run_stream(spark, root, period, schema, both, "topics")
    return spark.read.parquet(f"{root}/topics").drop("batch", "text"), last_weights(spark, root)
