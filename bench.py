"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

HEADLINE = ["qgram_overlap", "qgram_index", "qgram_hits", "qgram_diagonals", "exact_match", "hamming_match", "suffix_array", "backward_search", "lf_mapping", "align_global", "align_smith_waterman", "align_gotoh", "align_banded", "all_mapper", "read_mapper", "alignment_diff", "asof_join", "interval_join", "scans", "reduce_by_key"]


def main() -> None:
    from pyspark.sql import SparkSession

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from helixframe.plans import registry

    queries, took = registry.queries(), {}
    queries["reduce"](spark, folder).collect()  # starts the session's threads and compiles what all queries share
    for name in [*HEADLINE]:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
