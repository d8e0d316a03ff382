"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from facetgraph.plans.queries import QUERIES
from facetgraph.session import local_session

HEADLINE = [
    "icp_by_region", "quality_all", "relation_scores", "structural_view", "cooccurrence_view", "fixed_weight_fusion",
    "quality_all_suppliers", "relation_scores_suppliers", "structural_view_suppliers", "cooccurrence_view_suppliers",
    "normalized_laplacian_suppliers", "silhouette_suppliers", "calinski_harabasz_suppliers",
    "cosine_pairs_over_threshold", "cosine_row_sums", "silhouette_precomputed", "mean_pool_vectors",
    "class_relation_scores", "mention_pairs", "token_clean", "lemma_join", "term_removal", "collision_dedupe",
    "core_filter", "l1_fusion_3iter", "self_weighted_fusion", "k_sweep",
    "text_vectors", "cosine_rectangular_over_threshold", "silhouette_unclipped", "k_sweep_factors", "semantic_view_top5", "declared_types",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
