"""The registered queries: against their SQL where there is one, else their columns and rows."""

import pytest

from compare import both, connection
from slideframe.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_ann": ["query_id", "rank", "vec_id", "score"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted", "n_passages", "least_p"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_mixing": ["doc_id", "tokens", "domain", "posterior", "rate"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
    "op10_html_text": ["page_id", "title", "text"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    ours, theirs = both(spark, SF, connection(SF), queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.columns == COLUMNS[name]
    table = {"op2_ann": None, "op10_html_text": "pages"}.get(name, "documents")
    if table:
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
