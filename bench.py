"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice: `queries` has the better time, `first` that of the first run, `rows` what it gives.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation
from pyspark.sql import functions as F

from matchloom import session
from matchloom.plans import catalog

HEADLINE = (
    "t3_tfidf_topk", "j5_t10_dense_topk", "w3_gated_top_k", "c7_c8_pairs", "j6_under_path", "w12_w13_metrics", "a15_w11_fairness", "g11_c4_rerank",
    "c1_home_ranking", "j17_model_compare", "a9_roll_up", "g5_g8_topics",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.get_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, first, rows = catalog.queries(), {}, {}, {}
    catalog.queries()["a6_blanks"](spark, sf).collect()  # starts the JVM's compilers
    for name in HEADLINE:
        for again in (False, True):
            began, seen = time.time(), Observation()
            queries[name](spark, sf).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            seconds = round(time.time() - began, 3)
            if not again:
                first[name], rows[name] = seconds, seen.get["n"]
            took[name] = min(seconds, first[name])
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first": first, "rows": rows, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
