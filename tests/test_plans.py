"""Plan shape: no Python UDFs, pushed filters, one aggregation for the snapshot."""

from pyspark.sql import functions as F

from plotline.operators.market import market_snapshot
from plotline.plans import common as P
from plotline.config import ADAPTER_AS_OF as AS_OF
from plotline.sources.listings import read_table

from .conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_market_snapshot_single_aggregation_no_udf(spark):
    p = plan(market_snapshot(P.silver_df(spark, SF_SMALL), AS_OF))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # one aggregation shuffle (hash partitioning on the segment keys), no sort-merge join
    assert p.count("ObjectHashAggregate") + p.count("HashAggregate") >= 2
    assert "SortMergeJoin" not in p


def test_filters_and_columns_pushed_to_scan(spark):
    li = read_table(spark, SF_SMALL, "lineitem").filter(F.col("l_quantity") > 10).select("l_orderkey")
    p = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_literal_dims_broadcast(spark):
    p = plan(P.silver_df(spark, SF_SMALL).groupBy("state_tier").count())
    silver_plan = plan(__import__("plotline.operators.silver", fromlist=["silver"]).silver(
        P.bronze_df(spark, SF_SMALL), None, AS_OF))
    assert "BroadcastHashJoin" in silver_plan
    assert p


def test_market_snapshot_independent_of_partitioning(spark):
    """Exact-decimal averages and order-free aggregates: identical results for
    1 and 8 input partitions (not just equal after rounding)."""
    s = P.silver_df(spark, SF_SMALL)
    a = market_snapshot(s.coalesce(1), AS_OF).collect()
    b = market_snapshot(s.repartition(8, "listing_id"), AS_OF).collect()
    key = lambda r: (r["state"], r["zip_code"], r["property_type"])
    assert sorted(a, key=key) == sorted(b, key=key)


def test_layers_are_read_with_pushdown(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["filter_price_range"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(price), GreaterThanOrEqual(price," in p
    assert "ReadSchema: struct<price:double,listing_id:string>" in p


def test_investment_scores_without_a_shuffle(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["investment_scores"](spark, SF_SMALL))
    assert "SortMergeJoin" not in p and "hashpartitioning" not in p


def test_a_cluster_without_a_shared_folder_is_refused():
    from plotline.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    import pytest
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_files_follow_states_and_not_tasks(spark, tmp_path):
    import glob
    from plotline.operators.quality import write_by
    df = spark.range(5000).selectExpr("id", "concat('s', id % 5) AS state").repartition(40)
    write_by(df, str(tmp_path / "t"), "state")
    assert len(glob.glob(str(tmp_path / "t" / "state=*" / "*.parquet"))) <= 10
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5000


def test_two_folders_in_one_session_keep_their_own_tables(spark):
    import __spark_entry__ as E
    counts = [E.queries()["create_namespace"](spark, f"/root/testdata/{sf}").groupBy().sum("n").first()[0] for sf in ("sf0.001", "sf0.01")]
    want = [spark.read.parquet(f"/root/testdata/{sf}/lineitem.parquet").count() for sf in ("sf0.001", "sf0.01")]
    assert counts == want
    assert E.queries()["scan_table"](spark, "/root/testdata/sf0.01").count() == want[1]


def test_latest_version_has_a_row_for_every_address(spark):
    import __spark_entry__ as E
    df = E.queries()["latest_version"](spark, SF_SMALL)
    sold = P.silver_df(spark, SF_SMALL).filter("prev_sold_date IS NOT NULL")
    assert df.columns == ["a", "latest_sale", "listing_id"]
    assert df.count() == sold.selectExpr("concat_ws('|', street, city, state) AS a").distinct().count()


def test_a_split_by_class_deals_no_rows_by_class(spark):
    from plotline.operators.prep import exact_split
    df = spark.range(5000).selectExpr("cast(id AS string) AS k", "cast(id % 10 = 0 AS int) AS y")
    # with statistics that ask for no broadcast, as on large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_split(df, "k", 0.2, label="y")
        assert "SortMergeJoin" not in plan(out) and "ShuffledHashJoin" not in plan(out)
        assert {tuple(r) for r in out.groupBy("y").agg(F.sum("is_test")).collect()} == {(0, 900), (1, 100)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_listings_are_dealt_to_many_tasks(spark, tmp_path):
    from plotline.sources.listings import adapter_listings
    adapter_listings(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "raw"))
    import glob
    assert len(glob.glob(str(tmp_path / "raw" / "*.parquet"))) > 1


def test_silver_alone_writes_no_bronze(spark):
    from plotline.operators.quality import _exists
    sf = "/root/testdata/sf0.01"
    if not _exists(spark, P._layer_path(spark, sf, "bronze")):
        n = P.silver_df(spark, sf).count()
        assert not _exists(spark, P._layer_path(spark, sf, "bronze"))
        assert n == P.silver(P.bronze_df(spark, sf), P.census_df(spark, sf), AS_OF).count()
