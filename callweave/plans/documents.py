"""Sources, filters, dates, sets, samples and folds over the transcript view."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import dates, text as tx
from callweave.operators import filters as fl
from callweave.operators import words as wd
from callweave.plans.registry import query, table
from callweave.plans.sqltext import STOP_WORDS, STOP, TRANSCRIPTS, YEARQ, quoted
from callweave.session import checked_broadcast, fill_slots, scratch_path
from callweave.sources import stores, transcripts as tr


def view(spark, sf):
    return tr.derived_transcripts(table(spark, sf, "documents"))


def text_view(spark, sf):
    """The view for queries that work on the text itself: a scan of few splits is spread first."""
    return tr.derived_transcripts(fill_slots(table(spark, sf, "documents"), "doc_id"))


def stop_frame(spark, words=STOP_WORDS):
    """The raw stop list as an input table."""
    return spark.createDataFrame([(f" {w} ",) for w in words], "stopwords string")


def csv_rows(spark, sf):
    """The transcript view in the shape of the transcript files."""
    df = view(spark, sf)
    return df.select(
        "doc_id",
        F.year("created_at").alias("year"),
        "speakertypeid",
        F.col("text").alias("componenttext"),
        F.substring("text", 1, 80).alias("componenttextpreview"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("transcriptcreationdate_utc"),
    )


@query(
    "scan_transcripts",
    f"""WITH {TRANSCRIPTS}
SELECT doc_id, CAST(year(created_at) AS INTEGER) AS year, speakertypeid, text AS componenttext,
  CAST(year(created_at) AS INTEGER) AS publish_year, CAST(month(created_at) AS INTEGER) AS publish_month
FROM transcripts WHERE year(created_at) <= 2025""",
)
def scan_transcripts(spark, sf):
    path = scratch_path(spark, "transcripts-csv")
    rows = csv_rows(spark, sf)
    # As exported files have it: a row number first, and the columns in another order than the schema's.
    rows = rows.select(F.col("doc_id").alias("Unnamed: 0"), *reversed(rows.columns))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    scanned = tr.with_publish_columns(tr.scan_transcripts(spark, path), "transcriptcreationdate_utc")
    return fl.year_cap(scanned, 2025, "publish_year").select(
        "doc_id", "year", "speakertypeid", "componenttext", "publish_year", "publish_month"
    )


@query(
    "row_cap",
    f"WITH {TRANSCRIPTS} SELECT doc_id, text FROM transcripts ORDER BY doc_id LIMIT 10000",
)
def row_cap(spark, sf):
    return fl.first_rows(view(spark, sf).select("doc_id", "text"), "doc_id", 10_000)


@query(
    "scan_stoplist",
    f"""WITH s AS (SELECT DISTINCT lower(trim(w)) AS word FROM (SELECT unnest([{quoted(STOP_WORDS)}]) AS w)),
t AS (SELECT lower(unnest(regexp_extract_all(text, '[^ \\n]+'))) AS word FROM documents)
SELECT word, count(*) AS n FROM t SEMI JOIN s USING (word) GROUP BY word""",
)
def scan_stoplist(spark, sf):
    path = scratch_path(spark, "stoplist")
    stop_frame(spark).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    words = tr.scan_word_list(spark.read.schema("stopwords string").option("header", True).csv(path), "stopwords")
    tokens = table(spark, sf, "documents").select(
        F.explode(tx.each(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0)))).alias("token")
    )
    counted = tokens.groupBy(F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(checked_broadcast(words), "word", "left_semi")


PROCESSED = f"WITH {TRANSCRIPTS}"


@query(
    "sink_docs",
    """SELECT t AS text, count(*) AS n FROM (
  SELECT trim(regexp_replace(text, '[\\s\\p{Z}\\x0b\\x85\\x1c-\\x1f]+', ' ', 'g')) AS t FROM documents)
WHERE length(t) > 30 GROUP BY t""",
)
def sink_docs(spark, sf):
    path = scratch_path(spark, "docs")
    docs = table(spark, sf, "documents").select(F.trim(F.regexp_replace("text", tx.SPACE + "+", " ")).alias("text"))
    stores.save_documents(fl.min_length(docs), path)
    return stores.load_documents(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_docs",
    "SELECT doc_id, length(text) AS n FROM documents",
)
def source_docs(spark, sf):
    path = scratch_path(spark, "processed")
    build = lambda: table(spark, sf, "documents").select("doc_id", "text")
    stores.load_or_build(spark, path, build)
    return stores.load_or_build(spark, path, build).select("doc_id", F.length("text").cast("long").alias("n"))


@query(
    "embedding_store",
    """SELECT vec_id AS doc_id, CAST(len(embedding) AS BIGINT) AS dims,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)), 6) AS total FROM embeddings""",
)
def embedding_store(spark, sf):
    root = scratch_path(spark, "model")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    stores.save_embeddings(vectors, root, "hashed/projection-64")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stores.load_embeddings(spark, root, "hashed/projection-64").select(
        "doc_id", F.size("embedding").cast("long").alias("dims"), F.round(total, 6).alias("total")
    )


@query(
    "append_results",
    f"""WITH {TRANSCRIPTS}, one AS (SELECT topic, count(*) AS n FROM transcripts GROUP BY topic)
SELECT topic, n, 'first' AS batch FROM one UNION ALL SELECT topic, n, 'second' FROM one""",
)
def append_results(spark, sf):
    path = scratch_path(spark, "results")
    rows = view(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    for batch in ("first", "second"):
        stores.append_results(rows.withColumn("batch", F.lit(batch)), path)
    return spark.read.schema("topic int, n long, batch string").option("header", True).csv(path)


@query(
    "sink_topic_info",
    f"WITH {TRANSCRIPTS} SELECT lang AS run, topic, count(*) AS n FROM transcripts GROUP BY lang, topic",
)
def sink_topic_info(spark, sf):
    path = scratch_path(spark, "topic-info")
    info = view(spark, sf).groupBy(F.col("lang").alias("run"), "topic").agg(F.count(F.lit(1)).alias("n"))
    stores.save_topic_info(info, path)
    stores.save_topic_info(info.where("run = 'en'"), path)  # a rerun replaces its own run only
    return spark.read.schema("topic int, n long, run string").parquet(path).select("run", "topic", "n")


@query(
    "ingest_by_quarter",
    f"""WITH {TRANSCRIPTS} SELECT {YEARQ} AS publish_yearq, count(*) AS n_docs FROM transcripts GROUP BY 1""",
)
def ingest_by_quarter(spark, sf):
    path = scratch_path(spark, "by-quarter")
    tr.ingest(view(spark, sf).withColumn("publish_yearq", dates.year_quarter(F.col("created_at"))), path)
    return spark.read.parquet(path).groupBy("publish_yearq").agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    "year_cap_filter",
    f"WITH {TRANSCRIPTS} SELECT doc_id, CAST(year(created_at) AS INTEGER) AS year FROM transcripts WHERE year(created_at) <= 2020",
)
def year_cap_filter(spark, sf):
    return fl.year_cap(view(spark, sf).select("doc_id", F.year("created_at").alias("year")), 2020)


@query(
    "year_range_filter",
    f"""WITH {TRANSCRIPTS} SELECT doc_id, CAST(year(created_at) AS INTEGER) AS year FROM transcripts
WHERE year(created_at) BETWEEN 2010 AND 2022""",
)
def year_range_filter(spark, sf):
    return fl.year_range(view(spark, sf).select("doc_id", F.year("created_at").alias("year")))


@query(
    "exclude_speaker",
    f"WITH {TRANSCRIPTS} SELECT doc_id, speakertypeid FROM transcripts WHERE speakertypeid IS DISTINCT FROM 1",
)
def exclude_speaker(spark, sf):
    return fl.exclude_speaker(view(spark, sf).select("doc_id", "speakertypeid"))


@query(
    "text_cast",
    f"WITH {TRANSCRIPTS} SELECT doc_id, coalesce(CAST(speakertypeid AS VARCHAR), 'nan') AS speaker FROM transcripts",
)
def text_cast(spark, sf):
    return view(spark, sf).select("doc_id", tx.cast_text(F.col("speakertypeid"), "literal").alias("speaker"))


@query("min_length_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 30")
def min_length_filter(spark, sf):
    return fl.min_length(table(spark, sf, "documents")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("drop_columns", "SELECT doc_id, text, lang FROM documents")
def drop_columns(spark, sf):
    return fl.drop_columns(table(spark, sf, "documents"), "source", "n_chars", "Unnamed: 0")


@query(
    "assign_row_id",
    f"""WITH {TRANSCRIPTS} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM transcripts
WHERE speakertypeid IS DISTINCT FROM 1""",
)
def assign_row_id(spark, sf):
    return fl.assign_row_id(fl.exclude_speaker(view(spark, sf)).select("doc_id"))


@query("alignment_check", """SELECT doc_id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def alignment_check(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return fl.check_alignment(table(spark, sf, "documents"), vectors)


@query("doc_length", "SELECT doc_id, length(text) AS length FROM documents")
def doc_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("length"))


@query(
    "category_cast",
    f"""WITH {TRANSCRIPTS} SELECT doc_id, CAST(topic AS VARCHAR) AS topic_label, CAST(topic AS BIGINT) AS topic_number
FROM transcripts""",
)
def category_cast(spark, sf):
    df = view(spark, sf).select("doc_id", F.col("topic").cast("string").alias("topic_label"))
    return df.withColumn("topic_number", F.col("topic_label").cast("long"))


@query(
    "union_chunks",
    f"""WITH {TRANSCRIPTS} SELECT doc_id, lang FROM transcripts WHERE year(created_at) <= 2018""",
)
def union_chunks(spark, sf):
    df = view(spark, sf)
    named = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    parts = [df.where(named), df.where(~named)]
    return tr.union_chunks([fl.year_cap(p.withColumn("year", F.year("created_at")), 2018) for p in parts]).select(
        "doc_id", "lang"
    )


@query("parse_timestamp", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS strict_ts,
  strftime(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP),
    '%Y-%m-%d %H:%M:%S') AS coerced_ts FROM events""")
def parse_timestamp(spark, sf):
    raw = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    dirty = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(raw)
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id",
        show(dates.parse_timestamp(raw)).alias("strict_ts"),
        show(dates.parse_timestamp(dirty, strict=False)).alias("coerced_ts"),
    )


@query("publish_year_month", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS publish_year,
  CAST(month(o_orderdate) AS INTEGER) AS publish_month FROM orders""")
def publish_year_month(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.publish_year(day).alias("publish_year"), dates.publish_month(day).alias("publish_month")
    )


@query("year_quarter", """SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR)
  AS yearq FROM orders""")
def year_quarter(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.year_quarter(F.col("o_orderdate")).alias("yearq"))


@query(
    "docs_per_quarter",
    f"""WITH {TRANSCRIPTS}, q AS (SELECT {YEARQ} AS yearq, count(*) AS n_docs FROM transcripts
  WHERE year(created_at) BETWEEN 2010 AND 2022 GROUP BY 1)
SELECT yearq, n_docs, (SELECT count(*) FROM q) AS n_groups FROM q""",
)
def docs_per_quarter(spark, sf):
    df = view(spark, sf).select(F.year("created_at").alias("year"), dates.year_quarter(F.col("created_at")).alias("yearq"))
    groups = fl.year_range(df).groupBy("yearq").agg(F.count(F.lit(1)).alias("n_docs"))
    return groups.withColumn("n_groups", groups.agg(F.count(F.lit(1))).scalar())


@query("sample_docs_first_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100000")
def sample_docs_first_n(spark, sf):
    return fl.first_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 100_000)


@query("sample_without_replacement", "SELECT event_id, value FROM events ORDER BY md5('42:' || event_id) LIMIT 5000")
def sample_without_replacement(spark, sf):
    return fl.sample_rows(table(spark, sf, "events").select("event_id", "value"), "event_id", 5000)


@query(
    "kfold_split",
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1) % 10 AS INTEGER) AS fold FROM documents",
)
def kfold_split(spark, sf):
    return fl.kfold_split(table(spark, sf, "documents").select("doc_id"))


@query("model_path_name", "SELECT page_id, replace(url, '/', '_') AS name FROM pages")
def model_path_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.model_path_name(F.col("url")).alias("name"))


@query(
    "stopword_antijoin",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) AS token FROM documents)
SELECT doc_id, count(*) AS kept FROM t WHERE lower(token) NOT IN ({quoted(STOP)}) GROUP BY doc_id""",
)
def stopword_antijoin(spark, sf):
    tokens = table(spark, sf, "documents").select(
        "doc_id", F.explode(tx.each(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0)))).alias("token")
    )
    stop = tr.scan_word_list(stop_frame(spark), "stopwords")
    return wd.stopword_antijoin(tokens, stop).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
