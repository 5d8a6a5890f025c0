"""Summarize the physical plan of every registered query into PLANS.md.

Per query, over its last plan and the plans of all tables it stages: shuffles (Exchange), broadcasts,
join strategies, Python nodes, windows, and each Parquet scan's pruned ReadSchema and PushedFilters.
Cross joins (CartesianProduct, BroadcastNestedLoopJoin) are flagged.
Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrameWriter  # noqa: E402

from corpuslab.plans import catalog  # noqa: E402
from corpuslab.session import get_spark  # noqa: E402

PYTHON = ["ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandasWithState"]
SCAN = re.compile(r"Location: \w+ \[([^\]]*)\]\n(?:PushedFilters: (\[.*?\])\n)?ReadSchema: (struct<.*?>)\n")
NODES = [*PYTHON, "Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Generate", "HashAggregate", "TakeOrderedAndProject"]


def named(location):
    """A scan's table, or a staged table's name without its unique suffix."""
    return re.sub(r"-[0-9a-f]{32}$", "", os.path.basename(location.split(",")[0].rstrip("/")))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("plans")
    explain_string = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    staged, write = [], DataFrameWriter.parquet

    def explained(df):
        return explain_string(df._jdf.queryExecution(), "formatted")

    def recorded(writer, *args, **kwargs):
        staged.append(explained(writer._df))
        return write(writer, *args, **kwargs)

    DataFrameWriter.parquet = recorded
    print("# Physical plans of the registered queries\n")
    print(f"Planned on `{sf_dir}` with local[{os.environ.get('BENCH_CPUS', '8')}] (AQE re-plans joins at run time). "
          "Counts are over a query's last plan and the plans of the tables it stages.\n")
    print("| query | staged tables | exchanges | broadcasts | SMJ | BHJ | python nodes | windows | cross joins |")
    print("|---|---|---|---|---|---|---|---|---|")
    details = []
    for name, q in sorted(catalog.queries().items()):
        staged.clear()
        last = explained(q(spark, sf_dir))
        texts = [*staged, last]
        count = Counter()
        for text in texts:
            tree = text.split("\n\n")[0]
            count.update({n: len(re.findall(rf"(?:^|[\s+\-:]){re.escape(n)}(?: \w+)* \(\d+\)", tree, re.M)) for n in NODES})
        py = sum(count[n] for n in PYTHON)
        cross = count["CartesianProduct"] + count["BroadcastNestedLoopJoin"]
        print(f"| {name} | {len(texts) - 1} | {count['Exchange']} | {count['BroadcastExchange']} | {count['SortMergeJoin']} | "
              f"{count['BroadcastHashJoin']} | {py} | {count['Window']} | {'**' + str(cross) + '**' if cross else 0} |", flush=True)
        scans = [scan for text in texts for scan in SCAN.findall(text)]
        details.append((name, list(dict.fromkeys((named(loc), pushed, schema) for loc, pushed, schema in scans))))
    print("\n## Scans (pruned columns and pushed filters)\n")
    for name, scans in details:
        print(f"* `{name}`")
        for table, pushed, schema in scans:
            print(f"  * `{table}` reads `{schema}`" + (f", pushed `{pushed}`" if pushed and pushed != "[]" else ""))


if __name__ == "__main__":
    main(sys.argv)
