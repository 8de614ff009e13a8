"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from callweave.plans import QUERIES
from callweave.session import build_session

HEADLINE = [
    "scan_transcripts",
    "preprocess_documents",
    "term_counts",
    "phrase_scores",
    "smart_ngrams",
    "build_vocab",
    "count_vectorize",
    "class_tfidf",
    "topk_terms_per_topic",
    "coherence_cv",
    "embed_documents",
    "pca_reduce",
    "knn_graph",
    "kmeans_topics",
    "assign_topics",
    "density_topics",
    "silhouette_exact",
    "optimal_k",
    "cross_validate",
    "k_sweep",
    "online_bow_decay",
    "online_fit_yearly",
    "fold_means",
    "topic_info",
    "grid_search",
    "kmeans_minibatch",
    "online_fit_stream",
    "online_bow_decay_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
