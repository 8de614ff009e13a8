"""The registered query of each operator, over its whole table, with the same query for a SQL engine where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.llm import chat, codes, decontaminate, infill, jaccard, language, licenses, lines, nearest, pieces, substrings, token_counts, toxicity
from callweave.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _digest(column):
    return F.sha2(column.cast("binary"), 256)


@query(
    "op1_benchmark_decontamination",
    f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k
        FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
    ),
    spots AS (
        SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
    ),
    hit AS (SELECT rid, n, s, item FROM spots JOIN win USING (n, k)),
    cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
    names AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover USING (rid) LEFT JOIN names USING (rid)
    """,
)
def op1(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", _digest(F.array_join("item_ids", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op2_line_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    e AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
    k AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
    ),
    shared AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.*, owner IS NOT NULL AND k.doc_id IS DISTINCT FROM owner AS gone FROM k LEFT JOIN shared USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY rid
    """,
)
def op2(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", _digest(F.col("text")).alias("kept_sha256"))


@query(
    "op9_substring_dedup",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    spots AS (
        SELECT rid, doc_id, s, array_to_string(w[s:s + 49], ' ') AS k
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)
    ),
    early AS (SELECT k, min(doc_id) AS m FROM spots GROUP BY k HAVING min(doc_id) < max(doc_id)),
    gone AS (
        SELECT DISTINCT rid, unnest(range(s, s + 50)) AS p FROM spots JOIN early USING (k) WHERE m < doc_id
    ),
    e AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    left_over AS (
        SELECT e.rid, count(gone.rid) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.rid IS NULL) AS kept
        FROM e LEFT JOIN gone USING (rid, p) GROUP BY e.rid
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN left_over USING (rid)
    """,
)
def op9(spark, sf_dir):
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _digest(F.col("text")).alias("kept_sha256"))


@query(
    "op6_ngram_jaccard_join",
    f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
    s AS (
        SELECT DISTINCT rid, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)
    ),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    inter AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM s a JOIN s b USING (k) WHERE a.rid <> b.rid GROUP BY a.rid, b.rid),
    link AS (
        SELECT a, b FROM inter JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 5 * i >= 4 * (x.n + y.n - i)
    ),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    class AS (SELECT a AS rid, min(doc_id) AS least FROM reach JOIN d ON d.rid = reach.b GROUP BY a),
    degree AS (SELECT a AS rid, count(*) AS n_links FROM link GROUP BY a)
    SELECT doc_id, coalesce(least(least, doc_id), least, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
    FROM d LEFT JOIN class USING (rid) LEFT JOIN degree USING (rid)
    """,
)
def op6(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def _fold(modulus: int, rest: int):
    """True for rows kept out of the training; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_fold(3, 1)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~_fold(4, 2)))
    return language.predict(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score")


@query("op4_license_scan")
def op4(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


_CONTROLS = r"<s>|</s>|\[INST\]|\[/INST\]|\\"


@query(
    "op5_chat_format",
    rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(20 + length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '{_CONTROLS}'))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def op5(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


@query("op8_nearest_neighbours")
def op8(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    read = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score",
        F.transform("others", lambda x: F.col("score") - x["loss"]).alias("next_scores"), _digest(F.col("text")).alias("decoded_sha256"),
    )


def _assigned(step: int) -> str:
    """Every part's nearest entry under the codebooks of one step, and the codebooks of the next."""
    return f"""
    gap{step} AS (SELECT rid, part, e, sum((x - y) * (x - y)) AS d FROM flat JOIN book{step} USING (part, pos) GROUP BY rid, part, e),
    near{step} AS MATERIALIZED (SELECT rid, part, e, d FROM (SELECT *, row_number() OVER (PARTITION BY rid, part ORDER BY d, e) AS r FROM gap{step}) WHERE r = 1)"""


def _moved(step: int) -> str:
    return f"""
    mean{step} AS (
        SELECT part, e, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS y
        FROM (SELECT part, e, pos, sum(x) AS s, count(*) AS n FROM near{step} JOIN flat USING (rid, part) GROUP BY part, e, pos)
    ),
    book{step + 1} AS MATERIALIZED (SELECT b.part, b.e, b.pos, coalesce(m.y, b.y) AS y FROM book{step} b LEFT JOIN mean{step} m USING (part, e, pos))"""


@query(
    "op11_vector_codes",
    f"""
    WITH every AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
    loose AS (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, len(v) // 16 AS width FROM every),
    kept AS MATERIALIZED (SELECT * FROM every WHERE rid NOT IN (SELECT rid FROM loose WHERE x IS NULL OR isnan(x) OR isinf(x))),
    flat AS MATERIALIZED (SELECT rid, i // width AS part, i % width AS pos, CAST(floor(256 * x) AS BIGINT) AS x FROM loose WHERE rid IN (SELECT rid FROM kept)),
    head AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept),
    book0 AS MATERIALIZED (SELECT part, e, pos, x AS y FROM flat JOIN head USING (rid) WHERE e < 64),
    {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
    coded AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY rid)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, e, pos)) FROM book2) AS codebooks_sha256
    FROM kept JOIN coded USING (rid)
    """,
)
def op11(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_token_counts")
def op12(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query(
    "op13_fill_in_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (
        SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (length(text) + 1) AS a,
            ('0x' || substr(h, 9, 8))::BIGINT % (length(text) + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS s
        FROM d
    ),
    cut AS (
        SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
            WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
            substring(text, 1, least(a, b)) AS p, substring(text, least(a, b) + 1, abs(a - b)) AS m, substring(text, greatest(a, b) + 1) AS t
        FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(least(a, b) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(abs(a - b) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || t || '<M>' || m ELSE '<S>' || t || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM cut
    """,
)
def op13(spark, sf_dir):
    done = infill.rearrange(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", _digest(F.col("output")).alias("output_sha256"),
        _digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
