"""Benchmark: run the headline catalogue queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full through the no-op sink (nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cv_scores", "kfold_stratified", "oof_baseline", "model_leaderboard", "ensemble_weighted",
    "pseudo_augment", "merge_fragments", "unlabelled_pool", "containment_pairs", "token_vocab",
    "truncate_pad", "batch_by_length", "pool_mean", "pool_weighted_layer", "feature_concat",
    "meter_running", "early_stop", "eta_report", "ridge_kfold_embeddings", "svr_rff_kfold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("GRADEWELL_MASTER", f"local[{cpus}]")
    os.environ.setdefault("GRADEWELL_SHUFFLE_PARTITIONS", str(max(8, 2 * int(cpus))))

    from gradewell.plans.registry import load_all
    from gradewell.session import build_session

    spark = build_session(app="gradewell-bench")
    qs = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # warm-up: JVM, parquet footers and readers of every table, Python workers
    from gradewell.sources.tables import TABLES, table

    for t in TABLES:
        table(spark, sf_dir, t).write.format("noop").mode("overwrite").save()
    qs["fragment_lengths"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        spark.catalog.clearCache()      # no query reads what another one cached
        t0 = time.perf_counter()
        qs[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
