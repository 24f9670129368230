"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pullwise.registry import all_queries
from pullwise.session import clean_up, local_session

HEADLINE = (
    "technique_costs", "technique_totals", "coverage_ceiling", "rule_scores", "purpose_matrix", "veracity", "substantiated_score",
    "technique_rank", "stability", "weight_sweep", "meter_cost", "merged_summary", "infer_layer", "stack_files", "date_normalise",
    "pseudonymise", "generalise_k_anonymity", "hl7_oru", "fhir_ancillary", "leak_audit", "export_audit", "exact_leak_scan",
    "audit_chain_build", "audit_chain_verify", "access_summary", "processing_record", "breach_assessment", "access_decisions",
    "split_layer_join", "page_links", "page_tables", "drift_fields", "drift_impact", "recognise", "recognise_requests",
    "audit_stream_daily",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    registered = all_queries()
    names = sys.argv[1:] or [n for n in HEADLINE if n in registered]
    registered["compliance_report"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warms the JVM up
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    clean_up(spark)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
