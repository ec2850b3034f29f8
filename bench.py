"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: the headline set below).
Each query's full plan is executed with the ``noop`` sink (every row is
produced, nothing is collected to the driver). The session is warmed up on
the flagship query at the bench scale (not reported), so JVM start-up and JIT
warm-up of Spark itself are not charged to the first timed query; every
timed query still plans, code-generates and runs its own plan from scratch.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.plans import registry  # noqa: E402
from cohortlens.session import build_session  # noqa: E402

# risk_distribution mirrors BASELINE's "bridge + features + risk counts" probe, ingest_features
# its bridge view, train_eval its forest fit + evaluate, drop_density / trend_line its grids.
HEADLINE = [
    "risk_by_class", "risk_distribution", "ingest_features", "analytics_by_class", "risk_cards", "score_means_by_risk",
    "difficulty_types", "recommendations", "recommendation_records", "scoped_counts",
    "correlation_matrix", "score_histogram", "variance_box", "variance_outliers", "drop_density",
    "trend_line", "validate_requests", "apply_predictions", "progress_trend", "csv_scan",
    "eval_metrics", "train_eval",
]


def run(spark, name, sf_dir) -> float:
    t0 = time.perf_counter()
    df = registry.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    registry.load_all()
    spark = build_session(f"local[{cpus}]", app="cohortlens-bench", shuffle_partitions=cpus * 2)
    for _ in range(2):                                # warm-up, not reported
        run(spark, "class_counts", sf_dir)
    times, failed = {}, {}
    for n in names:
        try:
            times[n] = round(run(spark, n, sf_dir), 3)
            print(f"{n}: {times[n]}s", file=sys.stderr)
        except Exception as e:  # noqa: BLE001 - report, keep timing the others
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"{n}: FAILED {failed[n]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf else None, "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
