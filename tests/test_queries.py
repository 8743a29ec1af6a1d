import pytest

from evidentia.plans.oracle import ORACLE_SQL
from evidentia.plans.queries import QUERIES

from .compare import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


def test_chunks_of_long_documents(spark, tmp_path):
    """Chunks are planned on whole texts, also behind 60,000 characters."""
    spark.createDataFrame([(1, "\n".join(f"{i:0100d}" for i in range(1, 1_001)), "en", "web", 100_999)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.symbol: (r.start_line, r.chars) for r in QUERIES["chunk_plan"](spark, str(tmp_path)).collect()}
    assert found == {None: (0, 4_000), "first": (1, 201), "rest": (3, 4_000), "far": (900, 4_000)}


def test_packets_query(spark):
    rows = QUERIES["evidence_packets"](spark, FOLDER).collect()
    assert rows and all(r["rank"] <= 11 for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["seed", "path", "confidence", "reason", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
