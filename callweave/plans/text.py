"""Text cleaning, tokens, transcript segments, lemmas and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import dates, text as tx
from callweave.functions.fixed import SAFE_HARBOR_WORDS
from callweave.operators import filters as fl
from callweave.operators import vocab as vc
from callweave.operators import words as wd
from callweave.plans.documents import stop_frame, text_view
from callweave.plans.registry import query, table
from callweave.plans.sqltext import (
    NOT_SPACE, SEEDS, SEED_GROUPS, SPACE, STOP, TRANSCRIPTS, YEARQ, clean, quoted, words2,
)
from callweave.session import fill_slots
from callweave.sources.transcripts import scan_word_list


def docs(spark, sf):
    return fill_slots(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def stop_words(spark):
    return scan_word_list(stop_frame(spark), "stopwords")


def seed_frame(spark):
    rows = [(i, w) for i, group in enumerate(SEED_GROUPS) for w in group]
    return spark.createDataFrame(rows, "`group` int, word string")


@query("remove_punct_digits", f"SELECT doc_id, {clean('text')} AS clean FROM documents")
def remove_punct_digits(spark, sf):
    return docs(spark, sf).select("doc_id", tx.remove_punct_digits(F.col("text")).alias("clean"))


@query(
    "word_tokenize",
    f"""SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM
(SELECT doc_id, regexp_extract_all({clean('text')}, '[^ ]+') AS t FROM documents)""",
)
def word_tokenize(spark, sf):
    df = docs(spark, sf).select("doc_id", tx.word_tokenize(tx.remove_punct_digits(F.col("text"))).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


@query(
    "vectorizer_tokenize",
    f"""SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM
(SELECT doc_id, {words2('text')} AS t FROM documents)""",
)
def vectorizer_tokenize(spark, sf):
    df = docs(spark, sf).select("doc_id", tx.vectorizer_tokenize(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


@query(
    "whitespace_tokenize",
    f"""SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM
(SELECT doc_id, regexp_extract_all(text, '{NOT_SPACE}+') AS t FROM documents)""",
)
def whitespace_tokenize(spark, sf):
    df = docs(spark, sf).select("doc_id", tx.whitespace_tokenize(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


@query(
    "remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all({clean('text')}, '[^ ]+'),
  lambda w: lower(w) NOT IN ({quoted(STOP)})), ' ') AS kept FROM documents""",
)
def remove_stopwords(spark, sf):
    df = docs(spark, sf).withColumn("tokens", tx.word_tokenize(tx.remove_punct_digits(F.col("text"))))
    return wd.remove_stopwords(df, stop_words(spark)).select("doc_id", tx.join_tokens(F.col("tokens")).alias("kept"))


@query(
    "remove_stopwords_by_sentence",
    f"""SELECT doc_id, array_to_string(list_transform(
  string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: array_to_string(list_filter(regexp_extract_all(s, '{NOT_SPACE}+'), lambda w: lower(w) NOT IN ({quoted(STOP)})), ' ')),
  ' ') AS kept FROM documents""",
)
def remove_stopwords_by_sentence(spark, sf):
    return docs(spark, sf).select("doc_id", tx.drop_words_by_sentence(F.col("text"), STOP).alias("kept"))


@query(
    "join_tokens",
    f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{NOT_SPACE}+'), ' ') AS joined FROM documents",
)
def join_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", tx.join_tokens(tx.whitespace_tokenize(F.col("text"))).alias("joined"))


SEGMENTS = f"""{TRANSCRIPTS}, parts AS (SELECT doc_id, string_split(body, '|||') AS p FROM transcripts),
segments AS (SELECT doc_id, list_slice(p, greatest(coalesce(list_position(p, 'Operator'), 0), 1) + 1, len(p)) AS s FROM parts)"""


@query(
    "transcript_body",
    f"WITH {SEGMENTS} SELECT doc_id, len(s) AS n, array_to_string(s, '|||') AS body FROM segments",
)
def transcript_body(spark, sf):
    df = text_view(spark, sf).select("doc_id", tx.transcript_segments(F.col("body")).alias("s"))
    return df.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|||").alias("body"))


HARBOR = f"""(len(list_filter(regexp_extract_all(lower(x), '{NOT_SPACE}+'), lambda w: w IN ({quoted(SAFE_HARBOR_WORDS)}))) > 2
  OR contains(lower(x), 'forward-looking') OR contains(lower(x), 'forward looking'))"""


@query(
    "remove_safe_harbor",
    f"""WITH {SEGMENTS} SELECT doc_id,
  array_to_string(list_filter(s, lambda x: x <> '' AND NOT {HARBOR}), '|||') AS kept,
  len(list_filter(s, lambda x: x <> '' AND {HARBOR})) > 0 AS flagged FROM segments""",
)
def remove_safe_harbor(spark, sf):
    df = text_view(spark, sf).select("doc_id", tx.transcript_segments(F.col("body")).alias("s"))
    return df.select(
        "doc_id",
        F.array_join(tx.remove_safe_harbor(F.col("s")), "|||").alias("kept"),
        tx.has_safe_harbor(F.col("s")).alias("flagged"),
    )


# The lexicon of the test corpus is made by rule from its own words.
LEXICON_SQL = f"""vocab AS (SELECT DISTINCT unnest(regexp_extract_all({clean('text')}, '[^ ]+')) AS form FROM documents),
lexicon AS (SELECT form, CASE WHEN length(form) > 4 AND form LIKE '%s' THEN left(form, length(form) - 1) ELSE form END AS lemma,
  CASE length(form) % 4 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'VERB' ELSE 'NOUN' END AS pos FROM vocab WHERE length(form) % 5 <> 0)"""


def lexicon(spark, sf):
    token = tx.word_tokenize(tx.remove_punct_digits(F.col("text")))
    form, size = F.col("form"), F.length("form")
    return (
        docs(spark, sf).select(F.explode(tx.each(token)).alias("form")).distinct().where(size % 5 != 0)
        .select(
            "form",
            F.when((size > 4) & form.endswith("s"), F.left(form, size - 1)).otherwise(form).alias("lemma"),
            F.when(size % 4 == 0, "ADJ").when(size % 4 == 1, "VERB").otherwise("NOUN").alias("pos"),
        )
    )


@query(
    "lexicon_join",
    f"""WITH {LEXICON_SQL}, t AS (SELECT unnest(regexp_extract_all({clean('text')}, '[^ ]+')) AS token FROM documents)
SELECT token, coalesce(lemma, token) AS lemma, coalesce(pos, 'NOUN') AS tag, count(*) AS n
FROM t LEFT JOIN lexicon ON token = form GROUP BY ALL""",
)
def lexicon_join(spark, sf):
    tokens = docs(spark, sf).select(F.explode(tx.each(tx.word_tokenize(tx.remove_punct_digits(F.col("text"))))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return wd.lexicon_join(counted, lexicon(spark, sf)).select("token", "lemma", "tag", "n")


@query(
    "lemmatize_pos",
    f"""WITH {LEXICON_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all({clean('text')}, '[^ ]+')) AS token,
  generate_subscripts(regexp_extract_all({clean('text')}, '[^ ]+'), 1) AS pos_no FROM documents),
j AS (SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos_no) AS lemmas FROM t LEFT JOIN lexicon ON token = form
  WHERE coalesce(pos, 'NOUN') IN ('NOUN', 'VERB') GROUP BY doc_id)
SELECT doc_id, coalesce(lemmas, '') AS lemmas FROM documents LEFT JOIN j USING (doc_id)""",
)
def lemmatize_pos(spark, sf):
    df = docs(spark, sf).select("doc_id", tx.word_tokenize(tx.remove_punct_digits(F.col("text"))).alias("tokens"))
    done = wd.lemmatize_pos(df, lexicon(spark, sf))
    return done.select("doc_id", tx.join_tokens(F.col("tokens")).alias("lemmas"))


TERMS = f"terms AS (SELECT unnest({words2('text')}) AS term FROM documents), tf AS (SELECT term, count(*) AS tf FROM terms GROUP BY term)"


@query("term_counts", f"WITH {TERMS} SELECT term, tf FROM tf")
def term_counts(spark, sf):
    return vc.term_counts(docs(spark, sf))


@query("term_cleanup", f"WITH {TERMS} SELECT term, tf FROM tf WHERE NOT regexp_full_match(term, '\\p{{Nd}}+') AND length(term) > 2")
def term_cleanup(spark, sf):
    return vc.term_cleanup(vc.term_counts(docs(spark, sf)))


UNION_VOCAB = f"""{TERMS}, merged AS (SELECT lower(unnest([{quoted(SEEDS)}])) AS term UNION SELECT term FROM tf WHERE tf > 15)"""
VOCAB = f"""{UNION_VOCAB}, vocab AS (SELECT term FROM merged WHERE NOT regexp_full_match(term, '\\p{{Nd}}+') AND length(term) > 2)"""


@query("union_vocab", f"WITH {UNION_VOCAB} SELECT term FROM merged")
def union_vocab(spark, sf):
    frequent = vc.term_counts(docs(spark, sf)).where("tf > 15")
    return vc.union_vocab(seed_frame(spark).select(F.lower("word").alias("term")), frequent)


@query("build_vocab", f"WITH {VOCAB} SELECT term FROM vocab")
def build_vocab(spark, sf):
    return vc.build_vocab(docs(spark, sf), seed_frame(spark))


@query(
    "vocab_semijoin",
    f"""WITH {VOCAB}, t AS (SELECT doc_id, unnest({words2('text')}) AS token FROM documents)
SELECT doc_id, count(*) AS kept FROM t WHERE token IN (SELECT term FROM vocab) GROUP BY doc_id""",
)
def vocab_semijoin(spark, sf):
    df = docs(spark, sf)
    tokens = df.select("doc_id", F.explode(tx.each(tx.vectorizer_tokenize(F.col("text")))).alias("token"))
    kept = wd.vocab_semijoin(tokens, vc.build_vocab(df, seed_frame(spark)))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "vocab_max_features",
    f"WITH {TERMS} SELECT term, tf FROM tf WHERE term NOT IN ({quoted(STOP)}) ORDER BY tf DESC, term LIMIT 10000",
)
def vocab_max_features(spark, sf):
    return vc.vocab_max_features(docs(spark, sf), STOP)


@query(
    "count_vectorize",
    f"""WITH {VOCAB}, d AS (SELECT doc_id, list_filter({words2('text')}, lambda w: w NOT IN ({quoted(STOP)})) AS t FROM documents),
g AS (SELECT doc_id, unnest(t) AS term FROM d UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d)
SELECT doc_id, term, count(*) AS tf FROM g WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term""",
)
def count_vectorize(spark, sf):
    df = docs(spark, sf)
    return vc.count_vectorize(df, vc.build_vocab(df, seed_frame(spark)), STOP)


@query(
    "token_dictionary",
    f"""WITH d AS (SELECT unnest(list_distinct(regexp_extract_all(text, '{NOT_SPACE}+'))) AS term FROM documents),
f AS (SELECT term, count(*) AS df FROM d GROUP BY term)
SELECT term, row_number() OVER (ORDER BY md5('42:' || term)) - 1 AS id, df FROM f""",
)
def token_dictionary(spark, sf):
    return vc.token_dictionary(docs(spark, sf))


@query(
    "online_bow_decay",
    f"""WITH {TRANSCRIPTS}, q AS (SELECT {YEARQ} AS yearq, topic, text FROM transcripts WHERE year(created_at) BETWEEN 2010 AND 2022),
ages AS (SELECT yearq, row_number() OVER (ORDER BY yearq DESC) - 1 AS age FROM (SELECT DISTINCT yearq FROM q)),
t AS (SELECT yearq, topic, unnest({words2('text')}) AS term FROM q)
SELECT topic, term, round(sum(power(0.99, age)), 6) AS weight FROM t JOIN ages USING (yearq)
WHERE term NOT IN ({quoted(STOP)}) GROUP BY topic, term""",
)
def online_bow_decay(spark, sf):
    df = text_view(spark, sf).select("topic", "text", F.year("created_at").alias("year"), dates.year_quarter(F.col("created_at")).alias("yearq"))
    weights = vc.decayed_weights(fl.year_range(df), "yearq", stop=STOP)
    return weights.select("topic", "term", F.round("weight", 6).alias("weight"))
