"""The registered queries: contract columns, whole tables, and DuckDB's rows where SQL can say them."""

import duckdb
import pytest

from foliant.llm import queries

COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_substrings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_topk": ["query_id", "rank", "vec_id", "score"],
    "op7_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_packing": ["shard", "pack", "n_tokens", "n_segments", "doc_ids"],
    "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op10_jaccard": ["doc_id", "class_id", "n_copies", "n_links"],
    "op11_simhash": ["doc_id", "fingerprint", "component_id"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
ROWS = {"op3_url_filters": "pages", "op6_topk": None, "op8_packing": None, "op12_whitening": None, "op13_negatives": None}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = df.collect()
    table = ROWS.get(name, "documents")
    assert len(rows) == spark.read.parquet(f"{sf}/{table}.parquet").count() if table else rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = con.execute(queries.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_every_operator_has_one_query():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLES) <= set(COLUMNS)
