"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import ascii_lower, keyed, row_key
from callweave.session import checked_broadcast

# Stripped at both ends of a line; \n cannot occur inside one.
SPACE = " \t\x0b\x0c\r"


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) per row of ``docs``.

    Lines are exploded with their position, normalised and hashed (128 bits). A key of ``min_chars`` code points or more
    that ``min_docs`` documents hold loses all its lines except in the document with the largest id. The other lines come
    back in their order. Documents are counted by distinct id: repeated rows count once, and both keep or lose the same
    lines. Rows without an id count for no document and lose each line that is over the threshold. Null and empty text is
    one empty line. ``carry`` adds the whole input row as a column ``row``. Only hashes are shuffled by line, once for the counts; the shared
    lines are broadcast after a check of their size, so a line that stands everywhere gathers nowhere, and beyond the bound joined by a shuffle. Each text moves once, by document.
    """
    base = keyed(docs, id_col, text_col, carry).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("r", row_key("doc_id", "text"))
    lines = (
        base.select("doc_id", "r", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "r", "pos", _key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "r", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    shared = (
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("owner"))
        .where(F.col("n") >= min_docs).drop("n")
    )
    drops = (
        lines.join(checked_broadcast(shared), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("d"), F.col("r").alias("dr")).agg(F.collect_set("pos").alias("drop"))
    )
    whole = base.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("r") == F.col("dr")), "left")
    lines_of = F.split("text", "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("drop"))
    return whole.select(
        "doc_id", F.size(lines_of).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(keep, lambda i: F.element_at(lines_of, i + 1)), "\n")).alias("text"),
        *(["row"] if carry else []),
    )
