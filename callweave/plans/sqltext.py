"""Fragments shared by the SQL twins of the registered queries."""

from __future__ import annotations

# Frequent words of the test corpus, one written in capitals to exercise case-insensitive matching.
STOP_WORDS = [
    "the", "of", "and", "in", "is", "on", "it", "by", "for", "are", "with", "AN",
    "de", "la", "le", "et", "un", "der", "die", "und",
]
STOP = sorted({w.strip().lower() for w in STOP_WORDS})
# Two seed groups; one word is absent from the corpus, one is digits only, one is too short.
SEED_GROUPS = [["revenue", "tion"], ["2024", "ab", "with"]]
SEEDS = [w for group in SEED_GROUPS for w in group]

SPACE = r"[\s\p{Z}\x0b\x85\x1c-\x1f]"
NOT_SPACE = r"[^\s\p{Z}\x0b\x85\x1c-\x1f]"
PUNCT = r"[!-/:-@\[\]^_`{-~]"
WORD = r"[\p{L}\p{N}_]{2,}"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def r6(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END"


def clean(col: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({col}, '{PUNCT}', ' ', 'g'), "
        f"'{SPACE}+', ' ', 'g'), '\\p{{Nd}}+', '', 'g'))"
    )


def words2(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{WORD}')"


TRANSCRIPTS = """transcripts AS (
  SELECT doc_id, text, lang, source,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id % 5 AS INTEGER) END AS speakertypeid,
    CAST(DATE '2009-01-01' + CAST(doc_id * 37 % 6000 AS INTEGER) AS TIMESTAMP) AS created_at,
    'Welcome|||' || CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'Operator|||' END
      || replace(text, chr(10), '|||')
      || CASE WHEN doc_id % 7 = 0 THEN '|||These forward-looking statements involve risks' ELSE '' END AS body,
    CAST(CASE WHEN doc_id % 13 = 0 THEN -1 ELSE CAST(substr(source, 4) AS INTEGER) END AS INTEGER) AS topic
  FROM documents)"""

YEARQ = "CAST(year(created_at) AS VARCHAR) || 'Q' || CAST(quarter(created_at) AS VARCHAR)"
