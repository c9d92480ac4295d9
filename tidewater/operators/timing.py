"""How long a job took and how many rows it gave, as rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def run_timed(name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame], None] | None = None) -> dict:
    """Build and run a DataFrame once and report ``job``, ``rows`` (observed in
    the same pass, nothing is counted again) and ``seconds``. ``write`` is the
    action; without one the rows go to Spark's ``noop`` sink."""
    start = time.perf_counter()
    seen = Observation(f"timed {name}")
    df = build().observe(seen, F.count(F.lit(1)).alias("rows"))
    if write is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        write(df)
    return {"job": name, "rows": seen.get["rows"], "seconds": time.perf_counter() - start}
