"""Wall time of the headline queries, each after one warm-up run over the smallest scale that stands
beside the measured one. Prints one JSON line; the time that building a query's frame takes (staged intermediates) is part of it and also told apart."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cardloom.plans.session import clear_staged, local_session, tune  # noqa: E402
from cardloom.queries import load  # noqa: E402

HEADLINE = (
    "anomalies_by_severity", "card_rates", "first_valid_claim", "price_diff", "collection_value", "dex",
    "encounters", "score_duel", "weighted_draws", "resolve_set", "correct_numerators", "match_name",
    "reading_order", "assign_to_anchor", "nms", "top_k_cosine", "nearest_hash_per_set", "two_tier_score",
    "content_hash_dedup", "session_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = tune(local_session(os.environ.get("BENCH_CPUS", "8"), partitions=16))
    queries, _, _ = load()
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    times, building = {}, {}
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    for name in names:
        for warm in (True, False):
            start = time.time()
            df = queries[name](spark, small if warm and os.path.isdir(small) else folder)
            built = time.time()
            df.write.format("noop").mode("overwrite").save()
            if not warm:
                times[name], building[name] = round(time.time() - start, 3), round(built - start, 3)
            clear_staged(spark)
        print(name, times[name], building[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "building": building, "sf": os.path.basename(folder.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
