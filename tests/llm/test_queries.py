"""The SQL twins, over the given table and over a small one of awkward rows."""

from __future__ import annotations

import pytest

from callweave.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

LINE = "This line stands in many documents, and it is long enough to count."
PASSAGE = " ".join(f"word{i}" for i in range(70))
LEAK = "one two three four five six seven eight nine ten eleven twelve"
BASE = " ".join(f"near{i}" for i in range(120))

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "..."), (5, "a"), (None, LINE), (None, LINE), (None, BASE),
    *((10 + i, f"  {LINE.upper() if i % 2 else LINE}\t\nown line {i}\n{LINE}") for i in range(7)),
    (20, PASSAGE), (21, f"before {PASSAGE} after"), (22, PASSAGE), (22, PASSAGE), (22, f"other {PASSAGE}"), (23, f"{PASSAGE}\n{PASSAGE}"),
    (30, f"x {LEAK} y {LEAK}"), (31, "one two three four five six seven eight nine"), (32, "Short, ITEM!"), (33, "shorti tem"),
    (40, BASE), (41, BASE.replace("near60", "changed")), (42, BASE + " tail"), (43, BASE.upper()), (44, " ".join(BASE.split()[:60])), (45, "a b c d e"), (46, "A, b; c d e"),
    (50, "Été ▁ 漢字 \U0001f600 naïve space\x0bvt\x0cff\r\nend"), (60, "the " * 3000), (61, "y" * 5000),
]
ITEMS = [(1, LEAK), (1, LEAK), (2, "short item"), (3, None), (4, ""), (None, LEAK), (5, "one two three four five six seven eight nine ten"), (6, "not there at all")]
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ <s>"), (1, 1, "assistant", "</s>[INST] \\ <s>"), (2, None, None, None), (2, 1, "assistant", ""),
    (None, 3, "user", "a\\[INST]b"), (3, 0, "[/INST]", "role is a control"), (4, 0, "assistant", "漢字 \U0001f600\n"),
]
WIDE = [round(((i * 37) % 101) / 50 - 1, 2) for i in range(64)]
POINTS = [
    *((i, [x * (i % 7) / 3 for x in WIDE], None if i % 5 == 0 else i % 2) for i in range(90)), (3, WIDE, 1), (3, WIDE, 1), (None, WIDE[::-1], None),
    (100, None, 0), (0, None, 0), (-5, [float("nan"), *WIDE[1:]], 0), (-6, [*WIDE[:-1], float("-inf")], 1), (-7, [None, *WIDE[1:]], 1), (200, [0.0] * 64, 7),
]


@pytest.fixture(scope="module")
def awkward(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    documents(AWKWARD).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame(POINTS, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    documents([]).write.parquet(f"{path}/documents.parquet")
    for name, schema in (
        ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string"),
        ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


def connected(path):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward_rows(spark, awkward, name):
    assert compare(QUERIES[name](spark, awkward), connected(awkward), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op5_") else 0)
