"""Time the headline queries; one line of JSON."""

from __future__ import annotations

import json
import os
import time

from partwise import registry
from partwise.session import build_session

HEADLINE = ["matrix_build_m1", "transform_fixed_w", "model_fit", "quality_series", "bicv_rank1_table", "bicv_multi_rank", "decompositions_topn", "cosine_embeddings", "consensus_pairs", "kruskal_h", "bray_curtis"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    took = {}
    found["matrix_build_m1"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        begun = time.perf_counter()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
