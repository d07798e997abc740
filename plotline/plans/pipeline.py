"""The batch run: bronze -> silver -> market -> features -> valuation, rent,
lead scores and forecasts -> investment measures, each stage a Spark job that
replaces a table in one step (``sources.snapshots``).

The stages are a graph by the tables that they read: valuation, rent, lead
scores and forecasts need nothing of each other and run side by side, each in a
fair scheduler pool of its own. Each stage's commit names the run, so a run
that was stopped goes on behind the stages that it had finished.

Silver is written once (partitioned by state); the sold / active / all
splits are filters over that one table instead of three extra copies.
Downstream stages read the written tables, so each stage's lineage starts
at a table in the shared output folder.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import config as C
from plotline.operators import features as FE
from plotline.operators import forecast as FC
from plotline.operators import invest as IV
from plotline.operators import market as MK
from plotline.operators import silver as SV
from plotline.operators.clean import bronze
from plotline.plans import models as MD
from plotline.plans import versions as VS
from plotline.sources import snapshots as SN
from plotline.sources.census import census_fixture_documents, land_census_documents, parse_census, read_census_documents
from plotline.sources.listings import adapter_listings, read_listings_csv


@dataclasses.dataclass
class Run:
    """A run over a landed listings CSV (``csv_path``, with landed census
    responses in ``census_path`` if there are any) or over the adapter of the
    driver tables (``sf_dir``). ``as_of`` is the run's day."""

    spark: SparkSession
    out: str
    as_of: _dt.date
    sf_dir: str | None = None
    csv_path: str | None = None
    census_path: str | None = None
    test_states: Sequence[str] = tuple(C.AVM_TEST_STATES)
    down_payment_pct: float = C.Financing().down_payment_pct
    interest_rate: float = C.Financing().interest_rate
    hold_years: int = C.Hold().hold_years
    trees: MD.TreeParams = dataclasses.field(default_factory=MD.TreeParams)
    run_id: str = dataclasses.field(default_factory=lambda: uuid.uuid4().hex)
    timings: dict[str, float] = dataclasses.field(default_factory=dict)
    gates: list[dict] = dataclasses.field(default_factory=list)

    def __post_init__(self):
        if (self.sf_dir is None) == (self.csv_path is None):
            raise ValueError("give either sf_dir or csv_path")
        self.out = self.out.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def read(self, name: str) -> DataFrame:
        return SN.read(self.spark, self.path(name))

    def timed(self, name: str, fn: Callable[[], object]):
        t0 = time.perf_counter()
        out = fn()
        self.timings[name] = round(time.perf_counter() - t0, 3)
        return out

    def write(self, df: DataFrame, name: str, by: str | None = None, skip_empty: bool = False, placed: bool = False) -> int | None:
        """``placed``: rows that are read from a table partitioned by the same key, whose files already follow the key."""
        df = df.hint("rebalance", by) if by and not placed else df
        return SN.replace(df, self.path(name), (by,) if by else (), skip_empty)

    # ------------------------------------------------------------ stages
    def bronze(self):
        if self.csv_path:
            df = bronze(read_listings_csv(self.spark, self.csv_path), self.as_of)
        else:
            df = bronze(adapter_listings(self.spark, self.sf_dir), self.as_of, source_file=self.sf_dir)
        self.write(df, "bronze_listings", by="state")

    def census(self):
        if self.sf_dir and not self.census_path:
            self.census_path = self.path("landed_census")
            land_census_documents(census_fixture_documents(self.spark, self.sf_dir), self.census_path)
        if self.census_path:
            self.write(parse_census(read_census_documents(self.spark, self.census_path)), "census")

    def silver(self):
        census = self.read("census") if self.census_path or self.sf_dir else None
        self.write(SV.silver(self.read("bronze_listings"), census, self.as_of), "silver_listings", by="state", placed=True)

    def sold(self) -> DataFrame:
        return SV.sold_listings(self.read("silver_listings"))

    def active(self) -> DataFrame:
        return SV.active_listings(self.read("silver_listings"))

    def active_features(self) -> DataFrame:
        return FE.property_features(self.active(), self.read("market_snapshots"), feature_ts=False)

    def market(self):
        self.write(MK.market_snapshot(self.read("silver_listings"), self.as_of), "market_snapshots")

    def features(self):
        market = self.read("market_snapshots")
        self.write(FE.property_features(self.sold(), market), "property_features")
        lead = FE.lead_features(SV.all_listings(self.read("silver_listings")), market)
        self.write(FE.with_motivated_label(lead, self.sold(), self.active()), "lead_features")

    def valuation(self):
        """C-5: fit on the other states, gate on the test states, score the active listings."""
        model = MD.valuation_run(self.read("property_features"), self.trees, self.test_states)
        VS.save_version(self.spark, self.path("models"), "valuation", model.save, model.metrics["gate"])
        self.gates.append({"stage": "valuation", **model.metrics["gate"]})
        est = model.predict(self.active_features()).select(
            "listing_id", *C.ADDRESS_KEYS, "state_tier", "property_type", "price", "avm_estimate", "avm_low", "avm_high")
        self.write(est.withColumn("scored_at", F.current_timestamp()), "avm_estimates", skip_empty=True)

    def forecasts(self, horizon: int = C.FORECAST_HORIZON):
        fc = FC.price_forecasts(self.active(), self.as_of, horizon).withColumn("generated_at", F.current_timestamp())
        self.write(fc, "price_forecasts", skip_empty=True)

    def rent(self):
        """C-7: skipped (no table) when there are too few training rows."""
        model = MD.fit_rent(self.read("property_features"), dataclasses.replace(
            self.trees, max_depth=self.trees.max_depth - 1, patience=min(30, self.trees.patience)))
        if model is not None:
            VS.save_version(self.spark, self.path("models"), "rent", model.save)
            est = model.predict(self.active_features()).select(
                "listing_id", *C.ADDRESS_KEYS, "property_type", "price", "est_monthly_rent", "est_annual_rent")
            self.write(est.withColumn("scored_at", F.current_timestamp()), "rent_estimates", skip_empty=True)

    def lead(self):
        """C-8: skipped (no table) when there are too few training rows."""
        model = MD.fit_lead(self.read("lead_features"), dataclasses.replace(self.trees, max_iter=min(400, self.trees.max_iter)))
        if model is not None:
            VS.save_version(self.spark, self.path("models"), "lead", model.save, model.metrics["gate"])
            self.gates.append({"stage": "lead", **model.metrics["gate"]})
            scored = model.predict(self.read("lead_features"), fill="zero").select("listing_id", *C.ADDRESS_KEYS, "lead_score", "lead_tier")
            self.write(scored.withColumn("scored_at", F.current_timestamp()), "lead_scores", skip_empty=True)

    def investment(self):
        """C-9 over the written estimates, with the written rents if there are any."""
        est = self.read("avm_estimates").select("listing_id", *C.ADDRESS_KEYS, "state_tier", "avm_estimate")
        rent = self.read("rent_estimates") if SN.exists(self.spark, self.path("rent_estimates")) else None
        est = IV.with_rents(est, rent, keys=("listing_id",))
        fin = C.Financing(down_payment_pct=self.down_payment_pct, interest_rate=self.interest_rate)
        out = IV.investment_scores(est, fin=fin, hold=C.Hold(hold_years=self.hold_years), keep=("listing_id", *C.ADDRESS_KEYS))
        self.write(out, "investment_scores", skip_empty=True)

    def model(self, name: str, kind):
        """The last saved version of a model; None when there was nothing to fit."""
        folder = VS.last_folder(self.spark, self.path("models"), name)
        return kind.load(self.spark, folder) if folder else None

    def bundle(self):
        """K-2: what answers requests, saved as one version; it has no gate of its own (its models have theirs)."""
        found = VS.Bundle(self.model("valuation", MD.Valuation), self.model("lead", MD.Lead), FC.baseline_medians(self.active()))
        VS.save_version(self.spark, self.path("models"), "combined", found.save)

    def counts(self) -> DataFrame:
        """S-11 over the run's tables, as their writes counted them."""
        names = ("bronze_listings", "silver_listings", "market_snapshots", "property_features", "lead_features", "avm_estimates",
                 "price_forecasts", "rent_estimates", "lead_scores", "investment_scores")
        return SN.row_counts(self.spark, {n: self.path(n) for n in names})

    #: C-1 to C-9: every stage with the stages whose tables it reads.
    GRAPH = {"bronze": (), "census": (), "silver": ("bronze", "census"), "market": ("silver",), "features": ("silver", "market"),
             "valuation": ("features",), "forecasts": ("silver",), "rent": ("features",), "lead": ("features",),
             "investment": ("valuation", "rent"), "bundle": ("valuation", "lead")}
    STAGES = tuple(GRAPH)

    def _finished(self) -> dict[str, dict]:
        """Stages that this run has finished, by its log; the last record of a stage counts."""
        return {c["stage"]: c for c in SN.commits(self.spark, self.path(f"_runs/{self.run_id}"))}

    def _stage(self, name: str) -> None:
        """One stage in its own pool; its record in the run's log is the last thing it does."""
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            self.timed(name, getattr(self, name))
        finally:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        SN.note(self.spark, self.path(f"_runs/{self.run_id}"), {"stage": name, "seconds": self.timings[name], 
                                                                   "gates": [g for g in self.gates if g["stage"] == name]})

    def run_all(self, only: Sequence[str] = ()) -> dict[str, float]:
        """Run what this run has not finished yet, every stage as soon as those before it are done; with ``only`` no more
        than these stages need."""
        wanted, todo = set(), list(only or self.GRAPH)
        while todo:
            name = todo.pop()
            wanted.add(name)
            todo += self.GRAPH[name]
        done = set()
        for name, record in self._finished().items():
            done.add(name)
            self.gates += [g for g in record["gates"] if g not in self.gates]
        if self.sf_dir and not self.census_path and "census" in done:
            self.census_path = self.path("landed_census")
        running: dict[Future, str] = {}
        with ThreadPoolExecutor(len(self.GRAPH)) as pool:
            while not done >= wanted:
                for name in wanted - done - set(running.values()):
                    if done.issuperset(self.GRAPH[name]):
                        running[pool.submit(self._stage, name)] = name
                finished, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in finished:
                    f.result()  # a failed stage ends the run; what is running beside it finishes first
                    done.add(running.pop(f))
        return self.timings
