"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed from building its plan to the last result row, the
intermediate tables it writes included; rows go to the no-op sink.
``python bench.py name ...`` times the named queries instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from shelfscope import catalog
from shelfscope.session import local_session

HEADLINES = [
    # pages
    "extract_cards_by_ladder",
    "extract_embedded_listings",
    "page_links",
    # cleaning
    "normalize_listing",
    "dedup_first",
    "clean_listings",
    # entity resolution
    "token_sort_ratio",
    "leader_clusters_token_sort_85",
    "leader_clusters_jaccard_50",
    "resolve_entities",
    "best_offer",
    "assemble_gold",
    "match_listings",
    # analytics
    "price_dispersion",
    "relative_position",
    "is_lowest",
    "median_price_deviation",
    "store_scorecard",
    "category_dominance",
    "brand_tier",
    "price_sync_score",
    "city_correlation",
    # exploration
    "kpis",
    "market_share",
    "product_search",
    "ranked_offers",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def seconds(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    seconds("category_size")  # starts the JVM's workers, not reported
    times = {name: seconds(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": spark.sparkContext.defaultParallelism,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINES)
