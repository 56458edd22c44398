"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR names the folder of Parquet tables, BENCH_CPUS the number of cores.  Each query is
planned and run to the end several times after one untimed pass; the best run counts, as the rest
is compilation and other first-use cost.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tutorspark.session import local_session  # noqa: E402
from tutorspark.workload.queries import all_queries  # noqa: E402

HEADLINE = (
    "J3_prepared",
    "A7_school_dosage",
    "A4_dosage_metrics",
    "A8_subject_dosage",
    "A9_subgroup_gaps",
    "A11_ethnicity_dosage",
    "A14_outcome_metrics",
    "A18_cost_metrics",
    "A20_score_participation",
    "A26_daily_sessions",
    "A28_numeric_summary",
    "A41_topic_share_by_band",
    "F6_combined",
    "P4_typed_sessions",
    "V7_session_issues",
    "V8_student_rule_counts",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, app="tutorspark-bench", **{"spark.sql.shuffle.partitions": cpus})
    queries = all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for attempt in range(RUNS + 1):
            start = time.perf_counter()
            # Every column and row is computed, none is sent to the driver.
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 4)
    spark.stop()
    folder = Path(sf_dir).name
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(folder.removeprefix("sf")) if folder.startswith("sf") else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
