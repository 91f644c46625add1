"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    *(f"tpch_q{i:02}" for i in range(1, 23)),
    *(f"click_q{i:02}" for i in range(1, 44)),
    "join_star", "join_asof_backward", "join_range", "agg_rollup", "agg_high_cardinality", "agg_count_distinct", "win_top_n", "win_running_total", "win_sessions", "ds_rollup_rank", "ds_year_over_year", "fn_hof", "udf_pandas",
]


def main() -> None:
    from quarry.queries import catalog
    from quarry.session import get_spark

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    own, took = catalog(), {}
    for name in HEADLINES:
        best = []
        for _ in range(3):  # the first run compiles; the better of the other two counts
            began = time.perf_counter()
            own[name].build(spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best[1:]), 4)
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "orders", "events", "pages")}
    print(json.dumps({"metric": "sum of the headline queries' best warm times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
