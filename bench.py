"""Time the headline queries: ``python bench.py`` prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores. Each query runs once
to warm up (``cold``) and then ``BENCH_RUNS`` times; the best run counts. Results go to a sink
that reads every row and stores none.
"""

from __future__ import annotations

import json
import os
import time

from coffer.session import local_session
from workload.queries import QUERIES

HEADLINE = [
    "stg_transactions",
    "fct_pay_period_summary",
    "fct_pay_period_summary_calendar",
    "fct_pay_period_summary_by_customer",
    "fct_monthly_summary",
    "fct_savings_rate",
    "fct_budget_vs_actual",
    "fct_expense_group_summary",
    "v_monthly_summary",
    "v_budget_vs_actual",
    "assess_purchases",
    "budget_status",
    "detect_pay_dates",
    "monthly_spending",
    "monthly_totals",
    "search_transactions",
    "list_transactions_per_account",
    "import_statement_inserted",
    "import_statement_summary",
    "categorised_lines",
    "categorised_lines_by_join",
    "categorised_documents",
    "deduplicated_lines",
    "reconciled_totals",
    "scd2_budgets",
    "quality_report",
]


def run(query, spark, sf: str) -> float:
    began = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, cpus, **{"spark.driver.memory": "16g"})
    cold, warm = {}, {}
    for name in wanted.split(",") if wanted else HEADLINE:
        cold[name] = round(run(QUERIES[name], spark, sf), 3)
        warm[name] = round(min(run(QUERIES[name], spark, sf) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "ledger queries, total of best warm runs",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
