"""The thin queries: their columns, and the rows of those that SQL cannot express."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op2_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_source_mixing": ["doc_id", "source", "n_chars", "start_char", "block", "slot"],
    "op4_decontamination": ["doc_id", "item_id", "distance", "end_char"],
    "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_lm_scores": ["doc_id", "n_tokens", "mean_log_score"],
    "op8_warc_transactions": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op10_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "pipeline": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


def test_all_are_registered():
    assert set(COLUMNS) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in COLUMNS if n != "pipeline"])
def test_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    table = {"op1": "pages", "op6": "embeddings", "op8": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name not in ("op4_decontamination", "op12_embedding_whitening", "op13_chat_formatting"):
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
