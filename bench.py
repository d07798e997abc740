"""Benchmark: the batch run's stages (models included) over $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries"
(seconds per stage), "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plotline.config import ADAPTER_AS_OF  # noqa: E402
from plotline.plans.pipeline import Run  # noqa: E402
from plotline.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="plotline-bench-")
    os.environ.setdefault("PLOTLINE_DRIVER_MEMORY", "16g")
    spark = local_session(cores=cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16,
                          checkpoint_dir=f"file://{scratch}/checkpoints")
    run = Run(spark, f"{scratch}/tables", ADAPTER_AS_OF, sf_dir=sf_dir)
    t0 = time.perf_counter()
    timings = run.run_all()
    total = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "pipeline_total", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
