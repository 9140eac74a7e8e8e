"""Summarise the physical plans of the store-backed viewport operators.

For each operator: exchanges by kind, join strategies, aggregates, Python nodes, and the
pushed / partition filters that reach the Parquet scans. Run after ``bench``-style loading:

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sigstrata.operators import boxplot, histogram, outliers, signal_page, signal_range  # noqa: E402
from sigstrata.plans.panels import signal_series  # noqa: E402
from sigstrata.schemas import DAY_MS, HOUR_MS  # noqa: E402
from sigstrata.session import get_session, scratch_path  # noqa: E402
from sigstrata.sources.adapters import event_signals  # noqa: E402
from sigstrata.sources.store import SignalStore  # noqa: E402

NODES = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
         "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject",
         "WindowGroupLimit", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython", "Subquery")


def summarise(name, df) -> str:
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    body, _, subs = text.partition("===== Subqueries =====")
    counts = Counter()
    for section, tag in ((body, ""), (subs, " (in scalar subqueries)")):
        for m in re.finditer(r"^\((\d+)\) ([A-Za-z]+)(?: \[codegen id : \d+\])?\s*$", section, re.M):
            counts[m.group(2) + tag] += 1
        for m in re.finditer(r"^Arguments: (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
                             section, re.M):
            counts[f"Exchange {m.group(1)}{tag}"] += 1
    parts = sorted({p for p in re.findall(r"PartitionFilters: \[([^\]]*)\]", text) if p})
    pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", text) if p})
    keep = ("Exchange", "Join", "Aggregate", "TakeOrdered", "WindowGroupLimit", "Window", "InPandas",
            "EvalPython", "Scan", "Sort", "Generate", "Union")
    lines = [f"### {name}", "", "| operator | count |", "| --- | --- |"]
    lines += [f"| {k} | {v} |" for k, v in sorted(counts.items()) if any(w in k for w in keep)]
    lines += ["", "PartitionFilters: " + (" / ".join(parts) or "none"),
              "", "PushedFilters: " + (" / ".join(p[:200] for p in pushed) or "none"), ""]
    return "\n".join(lines)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    sig, ch = event_signals(spark, sf_dir)
    store = SignalStore(spark, scratch_path(spark, "plans"))
    store.write_channels(ch)
    store.bulk_load(sig)
    store.archive_before(store.overview().first()["max_ts"] - 10 * DAY_MS)
    o = store.overview().first()
    lo, hi = o["min_ts"], o["max_ts"]
    u = store.unified()
    cases = {
        "signal_range L0, 1 h, one channel": signal_range(u, 0, hi - HOUR_MS, hi, "L0"),
        "signal_range L1 (fresh), 7 d": signal_range(store.layer("L1"), 0, hi - 7 * DAY_MS, hi, "L1"),
        "signal_page, first page": signal_page(u, 500),
        "signal_page, next page (cursor)": signal_page(u, 500, cursor=(hi - DAY_MS, 0, 0.0)),
        "store.page, first page (newest days only)": store.page(500),
        "boxplot approx, 1 d buckets": boxplot(u, lo, hi, bucket_ms=DAY_MS),
        "boxplot exact, by channel": boxplot(u, lo, hi, quantile="exact"),
        "outliers, one channel, 1 d": outliers(u, 0, hi - DAY_MS, hi, 500),
        "histogram, one channel": histogram(u, 0, lo, hi, 20),
        "signal_series, full span (L2)": signal_series(store.layers(), 0, lo, hi, 800),
        "signal_series, 1 h (L0 + LTTB)": signal_series(store.layers(), 0, hi - HOUR_MS, hi, 800),
        "overview": store.overview(),
    }
    print(f"# Physical plans on a store loaded from {sf_dir} (archived up to 10 days before the end)\n")
    for name, df in cases.items():
        print(summarise(name, df))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
