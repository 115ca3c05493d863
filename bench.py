"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from weftgraph import catalog  # noqa: E402

NAMES = ["cone_degree", "arrow_upsert", "height_histogram", "closure_region", "boundary_parts", "label_propagate_closure", "global_numbering", "section_gather", "refine_copy", "assemble_mean", "hanging_constraints", "vertex_adjacency", "dual_graph_csr", "edge_cut", "replication_factor", "owner_min", "spmv", "reductions", "flux_residual_upwind", "quality_summary", "locate_points"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["cone_degree"](spark, d).write.format("noop").mode("overwrite").save()  # starts the JVM's and the reader's machinery
    took = {}
    for name in NAMES:
        began = time.time()
        queries[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
