"""The queries of this subpackage as they are registered: against their SQL where there is one, by their columns elsewhere."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from retail_spark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

#: Columns that the contracts name, and the table whose rows each query answers (None: rows of its own).
COLUMNS = {
    "op1_quality_rules": ({"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "documents"),
    "op2_temperature_mixing": ({"doc_id", "source"}, None),
    "op3_nearest_neighbours": ({"query_id", "rank", "vec_id", "score"}, None),
    "op4_license_scan": ({"doc_id"}, None),
    "op5_weak_quality": ({"doc_id"}, "documents"),
    "op6_pseudo_likelihood": ({"doc_id"}, "documents"),
    "op7_html_text": ({"page_id", "url", "text", "n_chars"}, "pages"),
    "op8_toxicity": ({"doc_id", "held_out", "score", "predicted"}, "documents"),
    "op9_ngram_jaccard_join": ({"doc_id", "n_shingles", "component_id"}, "documents"),
    "op10_packing": ({"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, None),
    "op11_personal_data": ({"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "documents"),
    "op12_centroid_clustering": ({"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}, "embeddings"),
    "op13_collocations": ({"lang", "rank", "phrase", "a", "l", "r", "n", "score"}, None),
}


def test_every_operator_is_registered():
    assert set(queries.queries()) == set(COLUMNS)
    assert set(queries.oracle_sql()) <= set(COLUMNS)
    registered = entry_points.queries()
    assert set(COLUMNS) | {"pipeline"} <= set(registered)
    assert set(queries.oracle_sql()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("key", COLUMNS)
def test_columns_and_rows(spark, key):
    columns, table = COLUMNS[key]
    found = queries.queries()[key](spark, SF)
    assert columns <= set(found.columns)
    if table:
        assert found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("key", queries.oracle_sql())
def test_matches_sql(spark, key):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = duck.execute(queries.oracle_sql()[key])
    names = [d[0] for d in result.description]
    found = queries.queries()[key](spark, SF).select(*names)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, result.fetchall()))
