"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """
content_terms query_ladder redact_secrets note_index select_passage document_sections exact_duplicates
classify_failure build_postings bm25_search bm25_or_topk batch_rung_search rrf_fusion dense_topk hybrid_recall
lexical_recency_topk raw_window_topk score_cases retrieval_metrics live_summary tag_stats corpus_digest cost_ledger
distributions arm_rates session_fold stale_events timeline_groups timeline_compress running_ceiling ack_prefix
tool_call_results opened_after_hit policy_audiences push_plan claim_applicability lineage_closure
scan_event_journal scan_native_transcripts locate_in_chunks index_diff stream_dedupe stream_session_windows
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    from memlake.queries import load
    from memlake.session import local_session

    spark = local_session(cpus, shuffle=int(cpus) * 2, app="bench")
    queries = load().QUERIES
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        # Every row is produced and dropped: nothing is pruned away and nothing reaches the driver.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total headline time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
