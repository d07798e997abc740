"""Print the formatted physical plans of the headline operators.

usage: python tools/explain.py [sf_dir] [stage ...]   (stages: market, features, forecast, investment)

The batch run's bronze/silver tables are written first (to a scratch folder),
so each plan starts at a parquet scan as it does in the pipeline.
"""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plotline import config as C  # noqa: E402
from plotline.operators import features as FE  # noqa: E402
from plotline.operators import forecast as FC  # noqa: E402
from plotline.operators import invest as IV  # noqa: E402
from plotline.operators.market import market_snapshot  # noqa: E402
from plotline.plans.pipeline import Run  # noqa: E402
from plotline.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    stages = sys.argv[2:] or ["market", "features", "forecast", "investment"]
    scratch = tempfile.mkdtemp(prefix="plotline-explain-")
    spark = local_session(checkpoint_dir=f"file://{scratch}/ck")
    run = Run(spark, f"{scratch}/tables", C.ADAPTER_AS_OF, sf_dir=sf)
    run.bronze(), run.census(), run.silver(), run.market()
    plans = {
        "market": lambda: market_snapshot(run.read("silver_listings"), C.ADAPTER_AS_OF),
        "features": lambda: FE.property_features(run.sold(), run.read("market_snapshots")),
        "forecast": lambda: FC.price_forecasts(run.active(), C.ADAPTER_AS_OF),
        "investment": lambda: IV.investment_scores(
            run.active().withColumn("avm_estimate", IV.F.col("price")), keep=tuple(C.ADDRESS_KEYS)),
    }
    for s in stages:
        print(f"===== {s} =====")
        plans[s]().explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
