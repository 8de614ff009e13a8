"""N-gram Jaccard join: candidates from a MinHash LSH forest, every one of them verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Rolling, WordHash, components, grouped, keyed, mix, row_key, slices, text_bytes, words
from callweave.session import fill_slots, materialise

TREES, DEPTH = 27, 6
# Chance that a pair exactly at the threshold meets in some tree.
RECALL = 0.999999
# Texts of a bucket compared in one task; larger buckets are cut into pairs of blocks.
BLOCK = 256
_COLUMNS = 8192


def stop_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """Length of the prefix at which the descent stops.

    Prefixes start at their full length and get shorter, one level at a time, until a pair at the threshold meets in one of
    the trees with probability ``recall``; more similar pairs meet with a higher one.
    """
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    if 1 - (1 - threshold**depth) ** trees < recall:
        raise ValueError("too few trees for this recall")
    return depth


class Signer:
    """Shingle sets of texts, and their sorted-trie keys: one hashed signature prefix a tree."""

    def __init__(self, size: int, trees: int, depth: int):
        self.size, self.trees, self.depth = size, trees, depth
        self.words, self.rolling = WordHash(), Rolling(0x9E3779B97F4A7C15)
        rng = np.random.default_rng(7)
        self.mult = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
        h = self.words.of(words(text))
        if not len(h):
            return h
        return np.unique(self.rolling.windows(h, min(self.size, len(h))))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.mult), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(shingles), 2048):
            part = shingles[a : a + 2048]
            for k in range(len(out)):
                low = (part * self.mult[k] + self.add[k]).min()
                if low < out[k]:
                    out[k] = low
        return out

    def keys(self, signature: np.ndarray, depth: int) -> np.ndarray:
        """The first ``depth`` values of each tree's signature as one number."""
        values = signature.reshape(self.trees, self.depth)
        out = np.arange(self.trees, dtype=np.uint64)
        for level in range(depth):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, level])
        return out


def _sign(size, trees, stop):
    def run(batches):
        signer = Signer(size, trees, stop)
        for batch in slices(batches):
            classes, counts, keys = [], [], []
            for text in text_bytes(batch, "text"):
                s = signer.shingles(text)
                counts.append(len(s))
                classes.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                keys.append(signer.keys(signer.signature(s), stop).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("r"), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "r", "c", "n", "keys"],
            )

    return run


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy() if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _fresh(keys: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, same: bool) -> np.ndarray:
    """Pairs of the bucket that meet in no earlier tree, so that each pair is verified in one place."""
    mask = np.ones((len(left), len(right)), bool)
    for t in range(tree):
        mask &= keys[left, t][:, None] != keys[right, t][None, :]
    return np.triu(mask, 1) if same else mask


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    bi, bj, own = table["bi"][0].as_py(), table["bj"][0].as_py(), table["own"].to_numpy()
    every = np.arange(table.num_rows)
    return (every, every, True) if bi == bj else (every[own == bi], every[own == bj], False)


def _wanted(table: pa.Table) -> pa.Table | None:
    """Members of a bucket that have a pair to be verified there."""
    left, right, same = _sides(table)
    if same and len(left) < 2:
        return None
    mask = _fresh(_matrix(table["keys"]), left, right, table["tree"][0].as_py(), same)
    some = np.unique(np.r_[left[mask.any(1)], right[mask.any(0)]])
    return table.select(["c", "tree", "key", "bi", "bj", "own"]).take(pa.array(some)) if len(some) else None


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of their incidence matrices in slices."""
    ours, theirs = np.concatenate([sets[i] for i in left]), np.concatenate([sets[i] for i in right])
    common = np.intersect1d(ours, theirs)
    out = np.zeros((len(left), len(right)), np.float64)

    def cells(which):
        sizes = [len(sets[i]) for i in which]
        row, value = np.repeat(np.arange(len(which)), sizes), np.concatenate([sets[i] for i in which])
        at = np.minimum(np.searchsorted(common, value), max(0, len(common) - 1))
        has = common[at] == value if len(common) else np.zeros(len(value), bool)
        order = np.argsort(at[has], kind="stable")
        return row[has][order], at[has][order]

    (lr, lc), (rr, rc) = cells(left), cells(right)
    for a in range(0, len(common), _COLUMNS):
        width = min(_COLUMNS, len(common) - a)
        part = []
        for rows, columns, n in ((lr, lc, len(left)), (rr, rc, len(right))):
            lo, hi = np.searchsorted(columns, [a, a + width])
            m = np.zeros((n, width), np.float32)
            m[rows[lo:hi], columns[lo:hi] - a] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _verify(size: int, trees: int, stop: int, threshold: float):
    signer: list[Signer] = []

    def run(table: pa.Table) -> pa.Table | None:
        if not signer:
            signer.append(Signer(size, trees, stop))
        left, right, same = _sides(table)
        mask = _fresh(_matrix(table["keys"]), left, right, table["tree"][0].as_py(), same)
        rows, cols = mask.any(1), mask.any(0)
        left, right, mask = left[rows], right[cols], mask[rows][:, cols]
        if not len(left):
            return None
        sets: dict[int, np.ndarray] = {}
        texts = table["text"].cast(pa.binary())
        for i in np.unique(np.r_[left, right]).tolist():
            sets[i] = signer[0].shingles(texts[i].as_py())
        n = {i: len(s) for i, s in sets.items()}
        both = _overlaps(sets, left, right)
        union = np.array([n[i] for i in left])[:, None] + np.array([n[i] for i in right])[None, :] - both
        linked = mask & (both >= threshold * union - 1e-9)
        if not linked.any():
            return None
        weight = table["size"].to_numpy()
        links = np.zeros(table.num_rows, np.int64)
        np.add.at(links, left, linked @ weight[right])
        np.add.at(links, right, linked.T @ weight[left])
        # A star to the least member of each local component stands for its links.
        root = np.arange(table.num_rows)
        changed = True
        while changed:
            before = root.copy()
            a, b = np.nonzero(linked)
            np.minimum.at(root, left[a], root[right[b]])
            np.minimum.at(root, right[b], root[left[a]])
            root = root[root]
            changed = bool((root != before).any())
        some = pa.array(np.flatnonzero(links))
        return pa.table({"c": table["c"].take(some), "links": pa.array(links).take(some), "root": table["c"].take(pa.array(root[np.flatnonzero(links)]))})

    return run


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, trees: int = TREES,
    depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, r, grp, class_id, n_links) per row of ``docs``.

    Two rows are linked when the Jaccard similarity of their sets of ``size``-word shingles is at least ``threshold``.
    ``n_links`` counts the other rows a row is linked with; ``class_id`` is the least id of all rows that links lead to.
    ``r`` is a hash of id and text that tells rows of one id apart, ``grp`` names the class even where no row has an id.

    Texts with the same shingle set are one member with a size, whatever their number. A member's signature is cut into
    trees; a tree's bucket holds the members that share a signature prefix of the length that ``stop_depth`` finds for the
    recall target. A pair that meets in several trees belongs to the first of them. Buckets first exchange keys alone, to find which
    members have a pair to verify there; only those send their text. Buckets above ``block`` members are cut into
    pairs of blocks, so a task holds two blocks at most, and no pair is ever a row: a task returns one row a member, with
    its number of links and the root of its local component.

    Null and empty text, and text without words, has no shingles, is linked with nothing and is a class of its own (``class_id`` is its
    id). A text of fewer than ``size`` words is one shingle. Repeated rows are linked like other copies. A row without an id
    counts as a link; its class id is the least id in its class, null if there is none.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("r", row_key("doc_id", "text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    stop = stop_depth(trees, depth, threshold, recall)
    signed_docs = materialise(
        fill_slots(base, "doc_id").mapInArrow(_sign(size, trees, stop), f"doc_id {kind}, r long, c binary, n long, keys array<long>"), "signed"
    )
    members = materialise(
        signed_docs.where("c is not null").groupBy("c").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "r")).alias("one"), F.count("*").alias("size"), F.min("keys").alias("keys")
        ), "members",
    )
    spots = members.select("c", F.posexplode("keys").alias("tree", "key"))
    shared = spots.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = spots.join(shared, ["tree", "key"]).withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int"))
    # Block pairs (i, j), i <= j, that a member takes part in.
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least("own", other).alias("bi"), F.greatest("own", other).alias("bj")),
    )
    placed = placed.withColumn("pair", F.explode(pairs)).select("c", "tree", "key", "own", "pair.bi", "pair.bj")
    spot = ["tree", "key", "bi", "bj"]
    wanted = materialise(
        grouped(
            placed.join(members.select("c", "keys"), "c"), spot, _wanted,
            "c binary, tree int, key long, bi int, bj int, own int",
        ), "wanted",
    )
    places = wanted.groupBy("c").agg(F.collect_list(F.struct(*spot, "own")).alias("places"))
    carried = (
        members.join(places, "c")
        .join(base.select(F.col("doc_id").alias("d"), F.col("r").alias("dr"), "text"), F.col("one.doc_id").eqNullSafe(F.col("d")) & (F.col("one.r") == F.col("dr")))
        .select("c", "size", "keys", "text", "places")
        .dropDuplicates(["c"])
        .withColumn("place", F.explode("places")).select("c", "size", "keys", "text", "place.*")
    )
    found = materialise(grouped(carried, spot, _verify(size, trees, stop, threshold), "c binary, links long, root binary"), "links")
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    classes = (
        members.select("c", "least", "size").join(roots.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left")
        .select("c", "least", F.coalesce("root", "c").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    ids = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    named = classes.join(ids, "root").select("c", F.col("root").alias("grp"), "class_id", "n_links")
    return signed_docs.select("doc_id", "r", "c").join(named, "c", "left").select(
        "doc_id", "r", "grp", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of linked rows: the one with the least id.

    Rows without an id give way to rows with one. Rows without shingles are linked with nothing and all stay.
    """
    found = similar_documents(docs, id_col, text_col, **options)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r")
    stay = found.where("grp is not null").groupBy("grp").agg(F.min(rank).alias("one")).select("one.doc_id", "one.r").select(name.alias("name"), "r")
    base = keyed(docs, id_col, text_col, True).withColumn("text", F.coalesce("text", F.lit("")))
    has_words = F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    named = base.where(has_words).select(name.alias("name"), row_key("doc_id", "text").alias("r"), "row")
    # Of rows that repeat in id and text one stays as well, unless they are linked with nothing.
    kept = named.join(stay, ["name", "r"]).groupBy("name", "r").agg(F.first("row").alias("row"))
    return kept.select("row").unionByName(base.where(~has_words).select("row")).select("row.*")
