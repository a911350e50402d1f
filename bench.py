"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import catalog  # noqa: E402
from tidewatch.session import get_session  # noqa: E402

HEADLINE = (
    "weekly_panel", "new_author_ratio", "cross_source_check", "quality_report", "pii_strip", "clean_text", "dedupe_keep_first",
    "lexicon_counts", "linguistic", "lexicon_sentiment", "sentiment_weekly", "feature_matrix", "topic_shift_jsd",
    "temporal_features", "state_labels", "fold_labels", "drift_levels", "escalations", "binary_metrics", "decision_usefulness",
    "lead_time_summary", "spearman_label", "feature_profile", "granger_lag1", "allocation", "template_brief",
    "model_walk_forward", "sequence_classifier", "weekly_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench")
    only = sys.argv[1:] or HEADLINE
    catalog.QUERIES["weekly_gap_fill"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in only:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    found = re.search(r"sf([0-9.]+)", os.path.basename(sf_dir.rstrip("/")))
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(found.group(1)) if found else sf_dir}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if times.get("feature_matrix"):
        out["texts_per_sec"] = round(docs / times["feature_matrix"], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
