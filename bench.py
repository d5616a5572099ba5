"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` (optional, comma separated) other queries to time.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "l15_lookup_corpus",
    "m01_build_ngrams",
    "m03_score_text",
    "k04_neighbours",
    "n01_search_keys",
    "d02_ctc_collapse",
    "d09_detect_gaps",
    "g02_drop_ruby",
    "g07_directional_neighbours",
    "l06_find_by_texts",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from kotonoha.plans import all_queries
    from kotonoha.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else [n for n in HEADLINE if n in all_queries.QUERIES]
    spark = build_session(
        "kotonoha-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": str(4 * int(cpus)),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine before timing anything
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
