"""Times the headline queries; prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Full-scan and 50,000-row timings are separate entries, since the published
schema and profile numbers are over a bounded sample.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue.queries import QUERIES
from colprism.functions import fixed
from colprism.operators import profile, schema
from colprism.plans.task import plan
from colprism.plans.training import train
from colprism.session import build, pin

REGISTERED = [
    "read_csv", "infer_schema_lineitem", "numeric_stats_lineitem", "histogram_lineitem", "duplicate_rows_lineitem",
    "category_stats_lineitem", "months_orders", "correlations_lineitem", "duplicate_rows_documents", "infer_schema_documents",
    "apply_recipe", "classification_metrics", "roc_auc", "fit_ridge", "fit_logistic_regression", "fit_dbscan",
    "fit_isolation_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    profile.profile(spark.read.parquet(f"{folder}/customer.parquet"), folded=True)  # warm the JVM

    def trained():
        orders = spark.read.parquet(f"{folder}/orders.parquet")
        found = pin(schema.infer_schema(orders, folded=True))
        train(orders, plan(orders, found, "o_totalprice"), ["ridge", "decision_tree"])

    jobs = {
        "profile_full": lambda: profile.profile(lineitem, folded=True),
        "profile_sampled": lambda: profile.profile(lineitem, folded=True, sample_rows=fixed.SAMPLE_ROWS),
        "schema_sampled": lambda: schema.infer_schema(lineitem, True, fixed.SAMPLE_ROWS).collect(),
        "schema_approx": lambda: schema.infer_schema(lineitem, True, distinct="approx").collect(),
        "plan": lambda: plan(lineitem, pin(schema.infer_schema(lineitem, True, distinct="approx")), "l_returnflag"),
        "train_two_models": trained,
    }
    for name in REGISTERED:
        jobs[name] = lambda name=name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, job in jobs.items():
        begun = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - begun, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
