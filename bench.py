"""Headline queries and jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = (
    "avg_order_by_quarter_and_place",
    "avg_by_period",
    "avg_by_state",
    "star_view",
    "fact_dedupe",
    "append_facts",
    "type_profile",
    "failure_policies",
    "export_frame",
    "join_sources",
    "overview",
    "payload_types",
    "check_integrity",
)


def timed(f) -> tuple[float, object]:
    start = time.perf_counter()
    out = f()
    return time.perf_counter() - start, out


def main() -> None:
    warnings.simplefilter("ignore")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("terrafact-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from queries import feeds as Q
    from queries import plans as P
    from terrafact.plans import jobs as J
    from terrafact.sources.warehouse import Warehouse

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # The JVM's first query pays for start-up.
    run(P.clean_orders(spark, SF_DIR))
    seconds: dict[str, float] = {}
    for name in QUERIES:
        seconds[name], _ = timed(lambda: run(P.QUERIES[name](spark, SF_DIR)))

    # Line items from CSV files to facts, and the same files again.
    files = P.write_csv(Q.lines_feed(spark, SF_DIR).repartition(int(CPUS)), f"{folder}/files")
    wh = Warehouse(spark, f"{folder}/wh")
    seconds["load_lines"], reports = timed(lambda: J.ingest_files(wh, Q.LINES, files))
    seconds["load_lines_again"], _ = timed(lambda: J.ingest_files(wh, Q.LINES, files))
    rows = sum(r.rows for r in reports)

    # Orders, with both dimensions, then reads from the tables.
    orders = P.write_csv(Q.orders_feed(spark, SF_DIR), f"{folder}/orders")
    seconds["load_orders"], reports = timed(lambda: J.ingest_files(wh, Q.ORDERS, orders))
    facts = wh.read("normalized_imports").filter("source_name = 'orders'")
    from terrafact.operators import analytics as A
    from terrafact.operators import payload as PY

    tall = PY.to_observations(facts, ["total_price"])
    seconds["stored_avg_by_period"], _ = timed(lambda: run(A.avg_by_period(tall, wh.read("dim_time"))))
    run_id = reports[0].ingest_run_id
    seconds["export_run"], _ = timed(lambda: J.export_run(wh, "orders", run_id, f"{folder}/exports"))
    count = facts.agg(F.count(F.lit(1))).first()[0]

    total = sum(seconds.values())
    print(
        json.dumps(
            {
                "metric": "total seconds of all queries and jobs",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "load_rows": rows,
                "load_rows_per_sec": round(rows / seconds["load_lines"]),
                "order_facts": count,
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
