"""Time the headline queries once, warm, and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectio.plans import catalogue  # noqa: E402
from lectio.session import local_session  # noqa: E402

HEADLINE = (
    "word_count", "content_terms", "token_set_jaccard", "style_violations", "compliance_mechanical", "novelty", "score_systems",
    "summarise_strata", "rule_diagnostic", "speech_gaps", "next_gap_asof", "transcript_window_next_event", "nearest_frame",
    "detect_moments", "cascade", "coverage_accuracy", "two_order_outcome", "rater_cells", "krippendorff_alpha", "spearman",
    "cluster_bootstrap", "resume_anti_join", "merge_repairs", "cosine_similarity", "described_so_far", "writer_contexts",
    "batch_faults", "probe_frames", "compliance_local", "rater_report", "stability_against_first", "scored_rows", "evaluate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    work = "sum(xxhash64(id, cast(id AS string)) % 1000)"
    for _ in range(2):  # the same work in every round, which tells how fast the machine is
        began = time.time()
        spark.range(60_000_000).selectExpr(work).collect()
        calibration = round(time.time() - began, 3)
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    for name in HEADLINE:
        f = catalogue.QUERIES[name]
        if os.path.isdir(small):  # compiles the code; the data read are others
            f(spark, small).write.format("noop").mode("overwrite").save()
        began = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "calibration": calibration, "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
