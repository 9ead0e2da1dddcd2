"""Headline match queries: candidates, planning and matching on a graph that is built first, as an index is. Median of runs 2 to 5."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from motifspark import catalog, testgraphs

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["match_wedge", "match_triangle", "match_cycle4", "match_clique4", "match_house", "match_v6_2", "count_star_factorized", "label_pair_cardinality"]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    t = time.perf_counter()
    g = testgraphs.purchases(spark, SF)
    g.links().count(), g.degrees().count(), g.signatures().count(), g.catalog()
    times["index_build"] = round(time.perf_counter() - t, 3)
    for name in NAMES:
        runs = []
        for _ in range(5):
            t = time.perf_counter()
            catalog.QUERIES[name](spark, SF).count()
            runs.append(time.perf_counter() - t)
        times[name] = round(median(runs[1:]), 3)
    total = sum(v for k, v in times.items() if k != "index_build")
    print(json.dumps({"metric": "match_total", "value": round(total, 3), "unit": "sec", "queries": times, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
