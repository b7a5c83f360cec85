"""Registered queries of the training-data operators over the smallest tables, and their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from meshlake.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op3_line_dedup": {"doc_id", "text", "n_lines", "n_removed"},
    "op4_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_simhash_dedup": {"doc_id", "fingerprint", "component_id"},
    "op7_quality": {"doc_id", "held_out", "score", "predicted"},
    "op8_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op9_license_scan": {"doc_id", "license", "containment"},
    "op10_decontamination": {"doc_id", "item_id", "similarity"},
}
PER_ROW = {k: "pages" if k == "op2_warc" else "documents" for k in COLUMNS if k not in ("op9_license_scan", "op10_decontamination")}


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in found)


def test_all_are_registered():
    assert set(registry.QUERIES) == set(COLUMNS)
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    out = got.collect()
    if name in PER_ROW:
        assert len(out) == spark.read.parquet(f"{SF}/{PER_ROW[name]}.parquet").count()
    if name in registry.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "pages"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(registry.ORACLES[name])
        assert rows(got.columns, out) == rows(want.columns, want.fetchall())
