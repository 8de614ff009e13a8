"""Nearest neighbours: multiprobe p-stable hashing with exact reranking, and an exact scan for queries the cells do not answer."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import grouped
from callweave.session import fill_slots, materialise

TABLES, HASHES, WIDTH = 8, 3, 0.6
# The fit: this many sample queries, recall to be reached on them, and probes a table at most.
SAMPLE_QUERIES, RECALL, MAX_PROBES = 64, 0.97, 512
# Vectors compared in one task group.
BLOCK = 4096
_ERF = np.frompyfunc(math.erf, 1, 1)


class Hashes:
    """``tables`` times ``hashes`` projections on Gaussian directions, cut into cells of ``width`` times the scale."""

    def __init__(self, dim: int, scale: float, tables: int, hashes: int, width: float, seed: int = 11):
        if not 1 <= hashes <= 3:
            raise ValueError("a cell number has room for 1 to 3 coordinates")
        rng = np.random.default_rng(seed)
        self.tables, self.hashes = tables, hashes
        self.directions = rng.standard_normal((dim, tables * hashes))
        self.width = width * scale
        self.shift = rng.random(tables * hashes) * self.width

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors @ self.directions + self.shift) / self.width).reshape(len(vectors), self.tables, self.hashes)

    @staticmethod
    def cells(places: np.ndarray) -> np.ndarray:
        """Cell coordinates as one number (21 bits a coordinate)."""
        out = np.zeros(places.shape[:-1], np.int64)
        for i in range(places.shape[-1]):
            out = (out << 21) | (np.clip(places[..., i], -(1 << 20), (1 << 20) - 1).astype(np.int64) + (1 << 20))
        return out


def probes(place: np.ndarray, count: int) -> np.ndarray:
    """Cells around ``place`` in the order of their estimated success.

    ``place`` is a projected query, in cells. A neighbour's projection is spread evenly about the query's, so a cell's chance falls
    with the squared distance from the query to its nearest border, summed over coordinates. Cells are taken from a
    heap: each coordinate lists its steps by rising cost, and a popped combination is followed by those one step further.
    """
    home = np.floor(place)
    steps = []
    for x, h in zip(place.tolist(), home.tolist()):
        reach = range(-count, count + 1) if count < 16 else range(-16, 17)
        steps.append(sorted((0.0 if d == 0 else (x - h - d if d < 0 else d - (x - h)) - (1 if d < 0 else 0), d) for d in reach))
        steps[-1] = [(c * c, d) for c, d in steps[-1]]
    start = (0,) * len(steps)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < count:
        _, at = heapq.heappop(heap)
        out.append([h + s[i][1] for h, s, i in zip(home.tolist(), steps, at)])
        for k in range(len(steps)):
            if at[k] + 1 < len(steps[k]):
                further = at[:k] + (at[k] + 1,) + at[k + 1 :]
                if further not in seen:
                    seen.add(further)
                    heapq.heappush(heap, (sum(s[i][0] for s, i in zip(steps, further)), further))
    return np.array(out)


def best(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest others with their exact distances; ties to the smaller id."""
    d = np.sqrt(((vectors - query) ** 2).sum(1))
    d[ids == own] = np.inf
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k)[k])
        ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))[:k]
    order = order[np.isfinite(d[order])]
    return ids[order], d[order]


def _rows(batch, name: str) -> np.ndarray:
    column = batch.column(name) if isinstance(batch, pa.RecordBatch) else batch[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, no non-finite component, not zero, of the most frequent length."""
    v: Column = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0))


def _scan(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """Exact nearest of the sample queries within each task: (query, vec_id, score, v)."""

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, sample.shape[1])))] * len(sample)
        for batch in batches:
            if batch.num_rows:
                ids, vectors = batch.column("vec_id").to_numpy(), _rows(batch, "v")
                by_id = np.argsort(ids, kind="stable")
                for q in range(len(sample)):
                    near, d = best(sample[q], ids, vectors, int(sample_ids[q]), k)
                    rows = vectors[by_id[np.searchsorted(ids, near, sorter=by_id)]]
                    old = found[q]
                    i2, d2, v2 = np.r_[old[0], near], np.r_[old[1], d], np.concatenate([old[2], rows])
                    order = np.lexsort((i2, d2))[:k]
                    found[q] = (i2[order], d2[order], v2[order])
        for q, (ids, d, v) in enumerate(found):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(d), pa.array(v.tolist(), pa.list_(pa.float64()))], ["q", "vec_id", "score", "v"]
                )

    return run


def sampled(data: DataFrame, queries: DataFrame, k: int, sample_queries: int) -> tuple[np.ndarray, list]:
    """A bounded sample of the queries, and their exact nearest as rows (q, rank, score, v)."""
    n = max(1, queries.count())
    sample = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < sample_queries).limit(2 * sample_queries).collect() or queries.limit(1).collect()
    if not sample:
        return np.zeros((0, 0)), []
    ids, vectors = np.array([r.vec_id for r in sample]), np.array([r.v for r in sample])
    local = data.mapInArrow(_scan(ids, vectors, k), "q long, vec_id long, score double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return vectors, local.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "score", "v").collect()  # sample_queries * k rows at most


def fit_scale(near: list) -> float:
    """Median distance from a sample query to the last of its neighbours; copies, at no distance, tell nothing."""
    last = {r.q: r.score for r in sorted(near, key=lambda r: r["rank"]) if r.score > 0}
    return float(np.median(list(last.values()))) if last else 1.0


def fit_probes(hashes: Hashes, vectors: np.ndarray, near: list, recall: float) -> int | None:
    """Probes a table needed to reach ``recall`` on the sample; none if ``MAX_PROBES`` do not reach it."""
    if not near:
        return 1
    places = hashes.project(vectors)
    order = [[{c: i for i, c in enumerate(Hashes.cells(probes(places[q, t], MAX_PROBES)).tolist())} for t in range(hashes.tables)] for q in range(len(vectors))]
    cells = Hashes.cells(np.floor(hashes.project(np.array([r.v for r in near]))))
    needed = sorted(min(order[r.q][t].get(int(c), MAX_PROBES) for t, c in enumerate(cell)) + 1 for r, cell in zip(near, cells))
    count = needed[math.ceil(recall * len(needed)) - 1]
    return count if count <= MAX_PROBES else None


def reach(places: np.ndarray, visited: list[np.ndarray], width: float, recall: float) -> float:
    """The distance up to which a row is in a visited cell of some table with a chance of ``recall`` or more.

    ``places`` is a projected query, in cells, and ``visited`` its cells in each table. The projections of a row at distance d differ from
    the query's by normal deviates of deviation d; the cells lie about the query without holes, so the chance falls with d.
    """
    low = [np.floor(c).astype(np.int64) - np.floor(p).astype(np.int64) for p, c in zip(places, visited)]
    side = max(int(np.abs(x).max()) for x in low)
    edges = np.floor(places)[..., None] + np.arange(-side, side + 2) - places[..., None]

    def chance(d: float) -> float:
        below = _ERF(edges * (width / (d * math.sqrt(2)))).astype(float)
        within = np.diff(below, axis=-1) / 2
        missed = 1.0
        for t, steps in enumerate(low):
            missed *= 1 - min(1.0, np.prod([within[t, h, steps[:, h] + side] for h in range(steps.shape[1])], axis=0).sum())
        return 1 - missed

    near, far = 0.0, width * (side + 1) * 4
    for _ in range(16):
        middle = (near + far) / 2
        near, far = (middle, far) if chance(middle) >= recall else (near, middle)
    return near


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES,
    width: float = WIDTH, sample_queries: int = SAMPLE_QUERIES, recall: float = RECALL, block: int = BLOCK, probes_per_table: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for the rows that ``queries`` selects (by ``vec_id``).

    Every usable row is indexed in ``tables`` hash tables of ``hashes`` p-stable projections. A query visits, in each table, the
    cells around its own in the order of their estimated success; how many is fitted on ``sample_queries`` queries to reach
    ``recall``, or given. Cells are ``width`` times the sample's median distance to the last neighbour wide, which a few long vectors do not
    move. In a cell the distances are computed exactly, and only the ``k`` best of each query leave it; the
    lists of all cells are merged. A query that then has fewer rows than there are, or whose last row lies farther than its cells
    hold rows with a chance of ``recall``, is compared with every row instead; so are all queries if the fit fails. Cells above ``block`` vectors or queries are cut into blocks of each, compared pair by pair. Of
    equal vectors the ``k`` + 1 smallest ids are indexed, as no result can hold more.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, as query or
    candidate, and neither do rows without an id. Repeated rows count once. Ties go to the smaller id. A query without any other row
    has no result.
    """
    spark = vectors.sparkSession
    data = materialise(fill_slots(usable(vectors, id_col, vector_col), "vec_id").distinct(), "vectors")
    asked = data.where(queries)
    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("vec_id")
    kept = data.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    kept = materialise(kept, "kept")
    first = data.select(F.size("v").alias("n")).first()
    out = "query_id long, rank int, vec_id long, score double"
    want = min(k, kept.count() - 1)
    if first is None or want < 1:
        return spark.createDataFrame([], out)
    sample, near = sampled(kept, asked, k, sample_queries)
    index = Hashes(first.n, fit_scale(near), tables, hashes, width)
    count = probes_per_table or fit_probes(index, sample, near, recall)
    ranked = lambda pairs: (
        pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
    if count is None:
        return ranked(_exact(kept, asked, k, block))
    sent = spark.sparkContext.broadcast(index)

    def place(many: int):
        def run(batches):
            h = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                places = h.project(_rows(batch, "v"))
                if many:
                    around = [[probes(p[t], many) for t in range(h.tables)] for p in places]
                    visited = np.stack([np.stack([_padded(Hashes.cells(c), many) for c in each]) for each in around])
                    far = np.array([reach(p, each, h.width, recall) for p, each in zip(places, around)])
                else:
                    visited, far = Hashes.cells(np.floor(places))[:, :, None], np.zeros(len(places))
                per = visited.shape[2]
                row = np.repeat(np.arange(batch.num_rows), h.tables * per)
                table = np.tile(np.repeat(np.arange(h.tables, dtype=np.int32), per), batch.num_rows)
                cell = visited.reshape(-1)
                some = cell >= 0
                for a in range(0, len(row), 20_000):
                    s = slice(a, a + 20_000)
                    use = some[s]
                    index_ = row[s][use]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(table[s][use]), pa.array(cell[s][use]), batch.column("vec_id").take(pa.array(index_)), pa.array(far[index_])], ["t", "cell", "vec_id", "reach"]
                    )

        return run

    placed = "t int, cell long, vec_id long, reach double"
    spots = materialise(kept.mapInArrow(place(0), placed).drop("reach"), "cells")
    probed = materialise(fill_slots(asked, "vec_id").mapInArrow(place(count), placed), "visits")
    visits = probed.drop("reach")
    # A cell is cut into blocks of vectors and blocks of queries; each pair of blocks is one group.
    cut = lambda rows, name: rows.groupBy("t", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = cut(spots, "subs").join(cut(visits, "parts"), ["t", "cell"])
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = spots.join(sizes, ["t", "cell"]).select("t", "cell", own("subs").alias("sub"), every("parts").alias("part"), "vec_id", F.lit(False).alias("ask"))
    asking = visits.join(sizes, ["t", "cell"]).select("t", "cell", every("subs").alias("sub"), own("parts").alias("part"), "vec_id", F.lit(True).alias("ask"))
    both = stored.unionByName(asking).join(data, "vec_id")

    found = materialise(ranked(_compared(both, ["t", "cell", "sub", "part"], k)), "found")
    last = found.where(F.col("rank") == want).select(F.col("query_id").alias("vec_id"), F.col("score").alias("last"))
    reached = probed.groupBy("vec_id").agg(F.max("reach").alias("reach")).join(last, "vec_id", "left")
    left = materialise(reached.where("last is null or last > reach").select("vec_id"), "left")
    answered = found.join(left.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti")
    return answered.unionByName(ranked(_exact(kept, asked.join(left, "vec_id"), k, block)))


def _exact(rows: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every block of rows for every query; no pair of blocks is more than one group."""
    subs, parts = (max(1, math.ceil(x.count() / block)) for x in (rows, asked))
    own = lambda n, name: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    stored = rows.select(own(subs, "sub"), every(parts, "part"), "vec_id", F.lit(False).alias("ask"), "v")
    asking = asked.select(every(subs, "sub"), own(parts, "part"), "vec_id", F.lit(True).alias("ask"), "v")
    return _compared(stored.unionByName(asking), ["sub", "part"], k)


def _compared(both: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, score): within each group of ``keys``, the ``k`` best of its rows for each of its queries."""

    def compare(group: pa.Table) -> pa.Table | None:
        ask = group["ask"].to_numpy(zero_copy_only=False)
        if not ask.any() or ask.all():
            return None
        ids, v = group["vec_id"].to_numpy(), _rows(group, "v")
        q, near, score = [], [], []
        for i in np.flatnonzero(ask):
            found, d = best(v[i], ids[~ask], v[~ask], int(ids[i]), k)
            q.append(int(ids[i]))
            near.append(found.tolist())
            score.append(d.tolist())
        return pa.table({"query_id": q, "near": pa.array(near, pa.list_(pa.int64())), "score": pa.array(score, pa.list_(pa.float64()))})

    lists = grouped(both, keys, compare, "query_id long, near array<long>, score array<double>")
    return lists.select("query_id", F.explode(F.arrays_zip("near", "score")).alias("x")).select("query_id", F.col("x.near").alias("vec_id"), F.col("x.score").alias("score"))


def _padded(cells: np.ndarray, n: int) -> np.ndarray:
    return np.r_[cells, np.full(n - len(cells), -1, np.int64)] if len(cells) < n else cells
