"""Times the headline queries and prints one JSON line.

Every result is computed in full and thrown away (`noop` sink). Each query is run on the
smallest tables first, so that what is timed is not the first use of its code. For some
queries the line also tells how time grows from a tenth of the rows, and the bytes shuffled.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registry.all import QUERIES  # noqa: E402
from spanwise.session import local_session  # noqa: E402

HEADLINE = [
    "s1_condense_spells",
    "s2_condense_spells_touching",
    "s3_invert_spells",
    "s4_gaps_within_bounds",
    "s5_intersect_spells",
    "s7_snapshots_to_spells",
    "s12_keep_longest_sequence",
    "s13_terminal_events",
    "s15_classify_roles",
    "s17_relative_events",
    "s19_overlap_join",
    "c10_date_overlaps",
    "l2_running_balance",
    "l3_lift_negative_cases",
    "l5_balance_at_quarters",
    "l6_cumulative_at_quarters",
    "l8_debt_cases",
    "a1_assemble",
    "a2_sum",
    "a9_duration_in_period",
    "a13_rectangular",
    "m4_employment_spells",
    "m6_neet_spells",
    "m7_benefit_roles",
    "m11_social_housing_spells",
    "m20_end_of_employment",
    "m28_ledger_debt_cases",
    "m28_ledger_debt_by_quarter",
    "m29_assessed_debt_by_quarter",
    "v_tidy_wide_table",
    "g2_distribution_by_group",
    "g3_totals_by_group",
    "g8_mean_sweep",
    "g9_pair_counts",
]


# Queries whose growth and shuffle are reported.
SCALED = ["s1_condense_spells", "s4_gaps_within_bounds", "l8_debt_cases", "a1_assemble", "g2_distribution_by_group"]


def run(spark, name: str, sf_dir: str, label: str = "warm-up") -> float:
    began = time.perf_counter()
    spark.sparkContext.setJobDescription(f"{label} {name}")
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def shuffled_mb(folder: str) -> dict[str, float]:
    """Megabytes written to shuffles by each timed query, from Spark's event log."""
    of_stage: dict[int, str] = {}
    written: dict[str, float] = {}
    for path in glob.glob(f"{folder}/*"):
        with open(path, encoding="utf-8") as file:
            for event in map(json.loads, file):
                if event["Event"] == "SparkListenerJobStart":
                    label, _, name = event["Properties"].get("spark.job.description", "").partition(" ")
                    if label == "timed":
                        of_stage |= dict.fromkeys(event["Stage IDs"], name)
                elif event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in of_stage:
                    metrics = event.get("Task Metrics", {}).get("Shuffle Write Metrics", {})
                    name = of_stage[event["Stage ID"]]
                    written[name] = written.get(name, 0.0) + metrics.get("Shuffle Bytes Written", 0) / 1e6
    return {name: round(written.get(name, 0.0), 2) for name in SCALED}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="run-")
    log = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch, "spark.eventLog.compress": "false",
           "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")}
    spark = local_session(cpus, shuffle_partitions=cpus, name="spanwise-bench", conf=log)
    spark.sparkContext.setLogLevel("ERROR")
    scale = os.path.basename(sf_dir).removeprefix("sf")
    root = os.path.dirname(sf_dir)
    smaller = f"{root}/sf{float(scale) / 10:g}" if scale.replace(".", "", 1).isdigit() else ""
    times, growth = {}, {}
    for name in HEADLINE:
        if os.path.isdir(f"{root}/sf0.001"):
            run(spark, name, f"{root}/sf0.001")
        times[name] = run(spark, name, sf_dir, "timed")
        if name in SCALED and os.path.isdir(smaller):
            growth[name] = round(times[name] / run(spark, name, smaller), 2)
    total = round(sum(times.values()), 3)
    spark.stop()
    more = {"time_for_10x_rows": growth, "shuffle_mb": shuffled_mb(scratch)}
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale, **more}))


if __name__ == "__main__":
    main()
