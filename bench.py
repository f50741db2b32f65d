"""Headline queries, timed.  Prints one JSON line.

    BENCH_SF_DIR   data folder   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores   (default 8)
    BENCH_RUNS     timed runs    (default 3; the median is reported, after one warm-up)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CONFIG = {
    "spark.driver.memory": "8g",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": CPUS,
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session():
    from pyspark.sql import SparkSession

    from tidegate import configure

    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    for name, value in CONFIG.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def timed(frame) -> float:
    """Median time of running a plan to its end, without keeping rows; of a function, with making the plan."""
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        (frame() if callable(frame) else frame).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return statistics.median(times[1:])


def main() -> None:
    from pyspark.sql import functions as F

    from tidegate.operators import delivery, proposals, repair, routing
    from tidegate.plans import feed, queries
    from tidegate.plans.staging import shared_folder, staged
    from tidegate.sources.catalog import Catalog
    from tidegate.streaming.shapes import ShapeDictionary

    spark, catalog = session(), Catalog.default()
    # the feed of sf0.1 is small, so it is written once and repeated with other positions
    parts = feed.part_feed(spark, SF_DIR)
    copies = parts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumns({
        "offset": F.col("offset") + F.col("_copy") * 10_000_000}).drop("_copy")
    log = staged(copies.repartition(int(CPUS) * 2), "feed")
    routed = routing.route_changes(log, catalog)
    dlq = staged(routing.to_dlq(routed), "dlq").withColumn(
        "event_id", F.concat_ws("-", "event_id", F.col("offset").cast("string")))
    found = staged(proposals.propose_from_report(proposals.repair_requests(dlq), catalog), "proposals")
    pending = staged(repair.pending_dlq(dlq), "pending")
    events = feed.event_changes(spark, SF_DIR)
    shapes = lambda: ShapeDictionary(f"{shared_folder(spark)}/shapes-{uuid.uuid4().hex}")
    state = staged(delivery.latest_per_key(events), "state")
    cases = {
        "route_changes": (routed.groupBy("outcome").count(), log),
        "validated_rows": (routing.to_validated(routed), log),
        # with all that it writes and runs before its result: the decoded dead letters, and the renames of shapes
        "dlq_rows": (lambda: routing.to_dlq(staged(routed.where(F.col("outcome").startswith("dlq:")), "dead"), meet=shapes().meet), log),
        "repair_decisions": (repair.repair(pending, found, catalog).groupBy("status").count(), pending),
        "upsert_current": (delivery.upsert_current(state, events), events),
        "dedupe_redelivered": (delivery.dedupe_batch(events.unionByName(events)), events),
        "routed_by_glob": (queries.QUERIES["routed_by_glob"](spark, SF_DIR), events),
        "narrow_fits": (queries.QUERIES["narrow_fits"](spark, SF_DIR), None),
        "changelog_rows": (queries.QUERIES["changelog_rows"](spark, SF_DIR), events),
        "stock_quantities": (queries.QUERIES["stock_quantities"](spark, SF_DIR), parts),
    }
    seconds, rates = {}, {}
    for name, (frame, source) in cases.items():
        seconds[name] = round(timed(frame), 3)
        if source is not None:
            rates[name] = round(source.count() / seconds[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": Path(SF_DIR).name, "cpus": int(CPUS), "config": CONFIG}))


if __name__ == "__main__":
    main()
