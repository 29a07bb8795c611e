"""Times the headline queries and prints one JSON line.

Each query is built, run and fully written to the no-op sink; one query before warms the session up.
"""

from __future__ import annotations

import json
import os
import time

from tenderlake.session import build_session, new_folder
from tenderlake.sources import tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "stg_contracts",
    "agg_by_supplier",
    "agg_by_process",
    "dim_suppliers",
    "dim_agencies",
    "dim_modalities",
    "dim_branches",
    "fct_contracts",
    "fct_amendments",
    "fct_contracts_branch",
    "mart_supplier_concentration",
    "mart_temporal",
    "mart_winner_diversity",
    "mart_cost_escalation",
    "top_suppliers_state",
    "report_data_quality_by_agency",
    "report_cost_change_by_modality",
    "profile_percentiles",
    "merge_latest",
    "history_scd2",
]


def main() -> None:
    from verification import derived
    from verification.registry import QUERIES, staged

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return time.time() - start

    # Deriving and storing the staged contracts is timed on its own; the marts read them.
    start = time.time()
    staged(spark, FOLDER)
    seconds = {"load_staging": round(time.time() - start, 3)}
    run("mart_cost_escalation")
    seconds |= {name: round(run(name), 3) for name in HEADLINE}

    # A dirty snapshot of the same contracts: checked, repaired, quarantined and published.
    snapshot = derived.write_dirty_snapshot(spark, FOLDER)
    start = time.time()
    tables.ingest_snapshot(spark, snapshot, new_folder(spark, "bench"), "v1").collect()
    seconds["ingest_snapshot"] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rsplit("/", 1)[-1],
                "spark": spark.version,
                "cores": int(CPUS),
                "shuffle_partitions": int(CPUS),
                "warm": True,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
