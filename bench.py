"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_QUERIES optionally a comma-separated list of registered queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citesift.registry import QUERIES  # noqa: E402

HEADLINE = (
    "retrieve",
    "merge_queries",
    "dedup_by_title",
    "label_by_title",
    "check_unique",
    "html_fields",
    "build_records",
    "search_term_features",
    "bigram_counts",
    "tfidf_vocab",
    "tfidf_transform",
    "lda_dictionary",
    "bag_of_words",
    "topic_coherence",
    "lda_fit",
    "standardize",
    "stratified_folds",
    "pr_curve",
    "gain_curve",
    "rank_documents",
    "fold_report",
    "ranked_export",
    "fit_l1_logistic",
    "evaluate_simple",
    "evaluate_full",
    "score_new",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("citesift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session(cpus)
    # Session start is not part of any query.
    spark.read.parquet(f"{sf_dir}/labels.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
