"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores. The queries of fifty fits (m4_tune,
m8_explain, v8_run) are not among them; their time at this size is not measured yet.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import catalog

HEADLINES = """r1_plain r3_judge r5_vote r6_first_int v1_evaluate a4_mcnemar a9_fold_stats p6_learned_wide p8_coerce
p14_text p16_titanic p21_zscore x1_split x2_folds x4_trials j2_predictions j2_hot_keys j7_attach g3_reasoning
g5_few_shot g12_few_shot s2_row_key t1_stream m1_fit m3_shap m3_additivity m6_medoid a11_silhouette m7_diverse""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["a1_accuracy"](spark, sf_dir).collect()  # warm up the JVM
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
