"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tempolith.queries import Layers, queries
from tempolith.session import session

QUERIES = ["late_labels", "peer_thresholds", "status_intervals", "stage_durations", "lead_time_profile", "asof_ge", "asof_strict", "open_count", "trailing_stats", "first_after", "feature_table", "average_precision", "topk_reasons"]


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # starts the executor
    # one after the other, as a session asks them: what one wrote serves the next
    with Layers(spark, folder) as layers:
        shared = {name: timed(lambda name=name: queries(layers)[name](spark, folder)) for name in QUERIES}
    # each by itself, with nothing written before it
    cold = {}
    for name in QUERIES:
        with Layers(spark, folder) as layers:
            cold[name] = timed(lambda name=name, layers=layers: queries(layers)[name](spark, folder))
    out = {"metric": "headline queries, total", "value": round(sum(shared.values()), 3), "unit": "sec", "queries": shared, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cold": cold, "cold_total": round(sum(cold.values()), 3)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
