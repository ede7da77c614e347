"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs once, in order, with its whole result written to a no-op sink; a tiny job first
starts the session and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketloom.plans import load_all
from marketloom.plans.registry import QUERIES
from marketloom.session import local_session

HEADLINE = (
    "a7_bars_in_range", "a16_newest_articles", "b6_clean_column", "b8_exact_dedupe",
    "b9_hash_dedupe", "b11_near_duplicates", "c1_score_headlines", "c5_daily_mean",
    "c6_daily_median", "d3_exact_search", "d5_search_by_text", "e3_macd_signal",
    "e17_smooth_ticks", "e21_feature_build", "e20_apply_scaler", "f4_sliding_windows",
    "h16_summary_table", "i2_article_series", "i7_latest_metrics", "j3_streaming_daily",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).mapInPandas(lambda batches: batches, "id bigint").count()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
