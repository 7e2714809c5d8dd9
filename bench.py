"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from lociq.plans import catalog
from lociq.session import session

HEADLINE = ("window_diversity_scan", "spectrum_statistics", "sparse_spectrum_statistics", "garud_h", "haf_top", "pairwise_moments", "ld_zns_omega", "focal_statistics", "raisd", "safe", "hscan", "ihs_scan", "lassi_t_lambda", "beta_scan", "window_means", "nearest_mark", "rank_genes", "merged_regions", "cms_score", "sweep_counts", "parsimony", "ancestral_posteriors", "classifier_metrics")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # the session warms up
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
