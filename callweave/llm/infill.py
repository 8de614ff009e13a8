"""Fill-in-middle: texts are cut into units by one match, and prefix, middle and suffix are rearranged between reserved signs."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import keyed, slices
from callweave.session import fill_slots

# Signs before prefix, suffix and middle. A unit is one code point unless the caller says otherwise.
SIGNS = ("<P>", "<S>", "<M>")
UNIT = r"(?s:.)"
# Of a hundred texts so many stay plain, and so many of the others have the suffix first.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four repeatable numbers below 2**32: the leading groups of eight digits of sha256(``seed:id``). A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def check_signs(signs: tuple[str, str, str]) -> None:
    """Reading back is unique only if no sign begins with the end of one: then none can arise where a sign meets text."""
    for a in signs:
        for b in signs:
            if any(a[i:] and b.startswith(a[i:]) for i in range(0 if a is not b else 1, len(a))):
                raise ValueError(f"the signs {a!r} and {b!r} overlap")
    if not all(signs) or len(set(signs)) < 3:
        raise ValueError("three different signs are needed")


def rearrange(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = UNIT, signs: tuple[str, str, str] = SIGNS,
    plain_share: int = PLAIN_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE, carry: bool = False,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs``.

    One ``fullmatch`` of ``(unit)*`` keeps the end of every repetition: their number is ``n``, and the ends after the smaller and
    the larger of two drawn numbers of units are the cuts. ``psm`` puts prefix, suffix, middle, ``spm`` suffix, prefix, middle, each
    after its sign; ``plain`` is the text as it stands. Plain are ``plain_share`` of a hundred texts, empty texts, texts that hold
    a sign, and texts that the units do not cover (``n`` is null then). The draws hang on ``seed`` and id alone, so repeated rows
    are cut alike. Null text is empty. Prefix and middle are counted in code points, and null if plain.

    Rows are independent and nothing is shuffled. A match takes some 60 bytes a unit, one text at a time. ``carry`` adds the whole
    input row as a column ``row``.
    """
    check_signs(signs)
    if regex.fullmatch(unit, "") is not None:
        raise ValueError("a unit must not be empty")
    names = [f"_h{i}" for i in range(1, 5)]
    base = fill_slots(
        keyed(docs, id_col, text_col, carry).withColumn("text", F.coalesce("text", F.lit("")))
        .withColumns(dict(zip(names, draws(F.col("doc_id"), seed)))), "doc_id",
    )
    row = ["row"] if carry else []

    def run(batches):
        units = regex.compile(f"({unit})*")
        held = regex.compile("|".join(map(regex.escape, signs)))

        def formed(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            match = units.fullmatch(text)
            if match is None:
                return None, "plain", None, None, text
            ends = match.ends(1)
            n = len(ends)
            if not text or h3 % 100 >= 100 - plain_share or held.search(text):
                return n, "plain", None, None, text
            few, many = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (ends[k - 1] if k else 0 for k in (few, many))
            prefix, middle, suffix = f"{signs[0]}{text[:a]}", f"{signs[2]}{text[a:b]}", f"{signs[1]}{text[b:]}"
            if h4 % 100 < suffix_first_share:
                return n, "spm", a, b - a, suffix + prefix + middle
            return n, "psm", a, b - a, prefix + suffix + middle

        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in slices(batches):
            done = [formed(*values) for values in zip(batch.column("text").to_pylist(), *(batch.column(h).to_pylist() for h in names))]
            columns = zip(*done) if done else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types)), *(batch.column(c) for c in row)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *row],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    carried = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    return base.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string{carried}")


def restored(output: Column, form: Column, signs: tuple[str, str, str] = SIGNS) -> Column:
    """The text behind an output of the given form; null output or form gives null."""
    p, s, m = (rf"\Q{x}\E" for x in signs)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)", "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)", "$2$3$1"))
    )
