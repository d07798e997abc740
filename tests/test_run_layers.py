"""The batch run's layers: silver is made where bronze's files lie."""

import json

from plotline import config as C
from plotline.plans.pipeline import Run

from .conftest import SF_SMALL


def test_silver_is_written_without_a_second_shuffle_of_the_listings(spark, tmp_path):
    run = Run(spark, str(tmp_path / "out"), C.ADAPTER_AS_OF, sf_dir=SF_SMALL)
    hinted = []
    plain = run.write
    run.write = lambda df, name, **kw: (hinted.append((name, "rebalance" in df._jdf.logicalPlan().toString().lower() or not kw.get("placed", False))),
                                        plain(df, name, **kw))[1]
    run.run_all(only=("silver",))
    assert dict(hinted) == {"census": True, "bronze_listings": True, "silver_listings": False}
    for name in ("bronze_listings", "silver_listings"):
        folders = [f for f in (tmp_path / "out" / name).glob("snapshot-*/state=*")]
        files = [p for f in folders for p in f.glob("*.parquet")]
        assert len(folders) > 1 and len(files) <= 2 * len(folders)  # files follow the states, not the tasks
        assert all(p.name.endswith(".zstd.parquet") for p in files)
    rows = run.read("silver_listings")
    record = json.loads(next((tmp_path / "out" / "silver_listings" / "_commits").glob("0*.json")).read_text())
    assert rows.count() == record["rows"] > 0
