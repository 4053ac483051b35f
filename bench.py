"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the
warm runs per query (the median is kept), BENCH_QUERIES a list of names.
"""

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pip_risk_concentration",
    "pip_facility_master",
    "pip_site_enrich",
    "pip_case_study",
    "pip_drilldown",
    "pip_enrollment",
    "pip_sample",
    "pip_survey",
    "pip_disbursement",
    "pip_reconcile",
    "pip_closed_grants",
    "pip_network",
    "agg_count_by_group",
    "agg_quantiles",
    "agg_consolidate",
    "win_top_k",
    "win_entity_id",
    "geo_within",
    "gph_cooccurrence",
    "lnk_fuzzy_top1",
    "rsh_multi_header",
    "svy_total_se",
    "txt_counts",
    "txt_dtm",
    "txt_gamma",
    "gph_subgraph",
]


def main():
    from pyspark.sql import SparkSession

    from granary.catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))  # after one run to warm up
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("granary-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's threads and the file reader before any timing
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()

    seconds = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
