"""Registered queries of the subpackage over whole small tables."""

import duckdb
import pytest

from orrery.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_dedup_lines": {"doc_id", "n_lines", "n_removed", "kept_sha256", "n_chars_kept"},
    "op2_identify_languages": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_dedup_substrings": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op4_score_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op6_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_simhash_components": {"doc_id", "fingerprint", "component_id"},
    "op8_filter_urls": {"page_id", "host", "path", "rule", "verdict"},
    "op9_pack_sequences": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10_near_duplicates": {"vec_id", "n_links", "component_id", "kept"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(df.columns) == COLUMNS[name]
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())
