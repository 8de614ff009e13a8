"""Text expressions: functions from Column to Column, evaluated inside the JVM.

The regular expressions use explicit character classes, because ``\\w`` and ``\\s`` cover ASCII only
in Java while the semantics wanted here are Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.fixed import SAFE_HARBOR_PHRASES, SAFE_HARBOR_WORDS

# ASCII punctuation without the backslash.
PUNCTUATION = r"[!-/:-@\[\]^_`{-~]"
# One whitespace character; repeated by the users below.
SPACE = r"[\s\p{Z}\x0b\x85\x1c-\x1f]"
NOT_SPACE = r"[^\s\p{Z}\x0b\x85\x1c-\x1f]"
DIGITS = r"\p{Nd}+"
WORD = r"[\p{L}\p{N}_]{2,}"
SEGMENT_MARK = r"\|\|\|"


def cast_text(column: Column, null_text: str = "drop") -> Column:
    """String form of a column. ``null_text='literal'`` turns a missing value into ``nan``."""
    text = column.cast("string")
    return F.coalesce(text, F.lit("nan")) if null_text == "literal" else text


def remove_punct_digits(text: Column) -> Column:
    """Punctuation to spaces, runs of whitespace to one space, then digits out, then trim.

    Digits go last, so a removed number between two words leaves two spaces.
    """
    spaced = F.regexp_replace(text, PUNCTUATION, " ")
    single = F.regexp_replace(spaced, SPACE + "+", " ")
    return F.trim(F.regexp_replace(single, DIGITS, ""))


def word_tokenize(clean: Column) -> Column:
    """Tokens of a text already cleaned by :func:`remove_punct_digits`."""
    return F.regexp_extract_all(clean, F.lit("[^ ]+"), F.lit(0))


def vectorizer_tokenize(text: Column, lowercase: bool = True) -> Column:
    """Runs of two or more letters, digits or underscores."""
    source = F.lower(text) if lowercase else text
    return F.regexp_extract_all(source, F.lit(WORD), F.lit(0))


def whitespace_tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))


def drop_words(tokens: Column, stop: list[str]) -> Column:
    """Tokens whose lower-case form is not in ``stop``; case, order and repeats are kept."""
    if not stop:
        return tokens
    return F.filter(tokens, lambda w: ~F.lower(w).isin(stop))


def drop_words_by_sentence(text: Column, stop: list[str]) -> Column:
    """Remove stop words sentence by sentence and join the sentences again.

    A sentence ends at ``.``, ``!`` or ``?`` before whitespace. A sentence that loses all its words
    still takes part in the final join, so it leaves a second space behind.
    """
    marked = F.regexp_replace(text, f"([.!?]){SPACE}+", "$1\u0001")
    sentences = F.split(marked, "\u0001")
    return F.array_join(
        F.transform(sentences, lambda s: F.array_join(drop_words(whitespace_tokenize(s), stop), " ")), " "
    )


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def each(tokens: Column) -> Column:
    """Elements of a computed array, for ``explode`` and ``posexplode``.

    A plain array expression under ``explode`` makes the optimizer derive a non-empty filter from it,
    which repeats the regular expressions of the array below the next exchange. Passing it through
    a null removal keeps the array computed once; tokens are never null, so nothing changes.
    """
    return F.array_compact(tokens)


def neighbours(tokens: Column) -> Column:
    """Array of ``(a, b)``: every token with its successor, the last one with null."""
    after = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.arrays_zip(tokens.alias("a"), after.alias("b"))


def transcript_segments(body: Column, drop_first_if_missing: bool = True, min_words: int = 1) -> Column:
    """Segments after the first one that reads exactly ``Operator``.

    Without such a segment the first segment is dropped all the same, unless
    ``drop_first_if_missing`` is false. A missing body gives no segments.
    """
    parts = F.split(F.coalesce(body, F.lit("")), SEGMENT_MARK)
    found = F.array_position(parts, "Operator").cast("int")
    skip = F.greatest(found, F.lit(1)) if drop_first_if_missing else found
    rest = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))
    return F.filter(rest, lambda s: F.size(F.split(s, SPACE + "+")) >= min_words)


def is_safe_harbor(segment: Column) -> Column:
    lowered = F.lower(segment)
    words = whitespace_tokenize(lowered)
    hits = F.size(F.filter(words, lambda w: w.isin(SAFE_HARBOR_WORDS)))
    named = F.lit(False)
    for phrase in SAFE_HARBOR_PHRASES:
        named = named | lowered.contains(phrase)
    return (hits > 2) | named


def remove_safe_harbor(segments: Column) -> Column:
    """Non-empty segments that carry no legal disclaimer."""
    return F.filter(segments, lambda s: (s != "") & ~is_safe_harbor(s))


def has_safe_harbor(segments: Column) -> Column:
    """True when any segment is a disclaimer (the rule that discards the whole transcript)."""
    return F.exists(segments, lambda s: (s != "") & is_safe_harbor(s))


def is_clean_term(term: Column) -> Column:
    """Not digits only and longer than two characters."""
    return ~term.rlike(r"^\p{Nd}+$") & (F.length(term) > 2)


def model_path_name(name: Column) -> Column:
    return F.regexp_replace(name, "/", "_")
