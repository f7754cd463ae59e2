"""Headline timings: one JSON line.  BENCH_SF_DIR picks the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans import registry  # noqa: E402
from barloom.session import build_session  # noqa: E402

HEADLINE = (
    "D01_resample_bars",
    "D03_validate_bars",
    "E12_build_features",
    "C15_evaluate_formulas",
    "hundred_rules",
    "G11_cv_stats",
    "G14_bootstrap_p",
    "G18_validate_population",
    "F06_cap_and_redistribute",
    "B13_screen_universe",
    "H01_book_impact",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    registry.QUERIES["flagship_rule_by_symbol"](spark, folder).count()  # start-up and code generation
    spent = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
