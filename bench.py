"""Headline queries on one folder of test tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from effectframe.queries import REGISTRY  # noqa: E402
from effectframe.session import local_session  # noqa: E402

HEADLINE = [
    "curate_labels",
    "group_split",
    "balanced_sample",
    "chunk_ids",
    "json_flatten",
    "seq_annotation_join",
    "merge_back",
    "variant_windows",
    "sequence_effects",
    "kmer_embed",
    "effect_vectors",
    "zscore_blocks",
    "feature_concat",
    "graph_build",
    "hub_prune",
    "edge_holdout",
    "random_walks",
    "roc_auc",
    "best_threshold",
    "evaluate_scores",
    "ablation_matrix",
    "prompt_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    # Starts the executor threads and the Parquet reader; not part of any query.
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
