"""Print the physical plans of registered queries.

    python tools/plans.py [sf_dir] [name ...]   (default: all batch queries, sf0.01)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.plans import QUERIES  # noqa: E402
from tidewater.session import get_spark  # noqa: E402

SKIP = ("stream_",)


def physical_plan(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", plan)
    return re.sub(r"#\d+L?", "", plan)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in QUERIES if not n.startswith(SKIP)]
    spark = get_spark("plans", {"spark.sql.shuffle.partitions": "16",
                                "spark.ui.showConsoleProgress": "false",
                                "spark.ui.enabled": "false"}, master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        print(f"### {name}\n\n```\n{physical_plan(QUERIES[name](spark, sf))}```\n")


if __name__ == "__main__":
    main()
