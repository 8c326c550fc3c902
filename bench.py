"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from lodestat.operators import (  # noqa: E402
    anomaly, charts, clean, convert, correlation, features, hypothesis, metrics, models, normalize, profile,
)

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
X, Y = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
LINE = [*X, Y]


def headline(read) -> dict:
    line, part = read("lineitem"), read("part")
    scaled = part.withColumns({"x": F.col("p_size") / 2.0, "y": F.col("p_retailprice") / 20.0})
    return {
        "d2_numeric_profile": lambda: profile.numeric_profile(line, LINE),
        "d3_categorical_profile": lambda: profile.categorical_profile(read("orders"), ["o_orderpriority", "o_orderstatus"]),
        "d5_text_profile": lambda: profile.text_profile(read("documents"), "text"),
        "c3_fill_median": lambda: clean.fill_missing(line, LINE, "median"),
        "c4_find_duplicates": lambda: clean.find_duplicates(read("documents"), "doc_id", "text"),
        "e4_pearson_matrix": lambda: correlation.pearson_matrix(line, LINE),
        "e5_spearman_matrix": lambda: correlation.spearman_matrix(line, LINE),
        "e6_kendall_matrix": lambda: correlation.kendall_matrix(read("orders"), ["o_custkey", "o_totalprice"]),
        "e12_hypothesis_suite": lambda: hypothesis.hypothesis_suite(line, LINE),
        "f2_iqr_outliers": lambda: anomaly.iqr(line, Y),
        "f6_dbscan_noise": lambda: anomaly.dbscan_noise(scaled, ["x", "y"], 0.05, 4),
        "f7_knn_distance": lambda: anomaly.knn_distance(scaled, ["x", "y"], 5, 0.1),
        "g4_robust": lambda: normalize.robust(line, LINE),
        "h4_label_encode": lambda: convert.label_encode(read("orders"), "o_orderpriority"),
        "j1_histogram": lambda: charts.histogram(line, Y),
        "j3_distribution": lambda: charts.distribution(line, Y),
        "k8_split": lambda: features.mark_test(read("orders"), "o_orderkey"),
        "l1_linear_regression": lambda: models.linear_regression(line, X, Y).scores(line),
        "l6_random_forest": lambda: metrics.regression_metrics(
            models.random_forest(line, X, Y, n_estimators=20, max_depth=5).transform(line), Y),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("lodestat-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times = {}
    for name, query in headline(lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")).items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
