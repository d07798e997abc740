"""Registered queries: scans, cleaning, filters, derived columns, joins, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import config as C
from plotline import oracle as O
from plotline.functions import columns as X
from plotline.operators import features as FE
from plotline.operators import silver as SV
from plotline.plans import common as P
from plotline.plans.catalog import register, sel
from plotline.sources.census import census_fixture_documents, census_fixture_rows, parse_census


def projection(key: str, frame, cols: list[str], sql_from: str, where: str = "", spark_filter=None):
    """Register a query that selects ``cols`` from a plan layer (optionally filtered)."""
    sql = O.with_base(f"SELECT {sel(cols)} FROM {sql_from}" + (f" WHERE {where}" if where else ""))

    def fn(spark, sf):
        df = frame(spark, sf)
        if spark_filter is not None:
            df = df.filter(spark_filter())
        return P.rounded(df.select(*cols))
    register(key, sql)(fn)
    return fn


RAW = ["brokered_by", "status", "price", "bed", "bath", "acre_lot", "street", "city", "state", "zip_code",
       "house_size", "prev_sold_date"]


# ------------------------------------------------------------------ sources
@register("scan_csv", O.with_base(f"SELECT {sel(RAW)} FROM adapter"))
def q_scan_csv(spark, sf):
    """S-1: the adapter listings landed as a header CSV, read with the declared schema."""
    from plotline.sources.listings import read_listings_csv, write_listings_csv
    from plotline.session import scratch_path
    path = scratch_path(spark, f"landing/{P.sf_key(spark, sf)}/listings_csv")
    write_listings_csv(P.raw(spark, sf), path)
    return P.rounded(read_listings_csv(spark, path))


_SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, true AS nullable, count({c}) AS non_null FROM adapter"
    for c, t in [(f.name, f.dataType.simpleString()) for f in __import__(
        "plotline.sources.listings", fromlist=["LISTING_SCHEMA"]).LISTING_SCHEMA.fields])


@register("scan_schema", O.with_base(_SCHEMA_SQL))
def q_scan_schema(spark, sf):
    """S-2: the declared schema with the non-null count of each field in the scan."""
    from plotline.sources.listings import LISTING_SCHEMA
    df = P.raw(spark, sf)
    counts = df.agg(*[F.count(f.name).alias(f.name) for f in LISTING_SCHEMA.fields])
    stack = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"),
                                         F.lit(f.dataType.simpleString()).alias("data_type"),
                                         F.lit(f.nullable).alias("nullable"),
                                         F.col(f.name).alias("non_null")) for f in LISTING_SCHEMA.fields]))
    return counts.select(stack.alias("s")).select("s.*")


@register("census_parse", O.with_base(
    f"SELECT {sel(['zip_code', *C.CENSUS_COLUMNS])} FROM census"))
def q_census_parse(spark, sf):
    """S-5 + P-33: census documents landed as files, read whole and parsed into counts and rates."""
    from plotline.session import scratch_path
    from plotline.sources.census import land_census_documents, read_census_documents
    path = scratch_path(spark, f"landing/{P.sf_key(spark, sf)}/census")
    land_census_documents(census_fixture_documents(spark, sf), path)
    return P.rounded(parse_census(read_census_documents(spark, path)))


@register("census_rates", O.with_base(
    f"SELECT {sel(['zip_code', *C.CENSUS_RATE_COLUMNS])} FROM census"))
def q_census_rates(spark, sf):
    """P-33: the five census rates."""
    return P.rounded(P.census_df(spark, sf).select("zip_code", *C.CENSUS_RATE_COLUMNS))


@register("numeric_coerce", O.with_base(
    "SELECT zip_code, coalesce(TRY_CAST(B19013_001E AS DOUBLE), 0) AS value FROM census_vals"))
def q_numeric_coerce(spark, sf):
    """P-43: unparsable text and NaN -> null -> filled with 0."""
    from plotline.functions.running import number
    rows = census_fixture_rows(spark, sf)
    return P.rounded(rows.select(F.element_at("row", -1).alias("zip_code"),
                                 F.coalesce(number(F.element_at("row", 2)), F.lit(0.0)).alias("value")))


@register("inline_dim", O.with_base(
    f"SELECT b.state, coalesce(t.state_tier, 'other') AS state_tier, count(*) AS listings "
    f"FROM bronze b LEFT JOIN {O.TIER_DIM} t ON b.state = t.state GROUP BY ALL"))
def q_inline_dim(spark, sf):
    """S-6: the literal tier map as a DataFrame, broadcast-joined to listing counts."""
    from plotline.functions.dims import join_literal_dim, tier_dim
    counts = P.bronze_df(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("listings"))
    out = join_literal_dim(counts, tier_dim(spark), "state", "left")
    return out.select("state", F.coalesce("state_tier", F.lit("other")).alias("state_tier"), "listings")


@register("lineage_cols", O.with_base(
    "SELECT 'realtor_national_csv' AS data_source, state, count(*) AS listings, count(*) AS with_time, "
    "count(*) AS from_landing FROM adapter GROUP BY state"))
def q_lineage_cols(spark, sf):
    """S-4: ingestion time, source path (from the scan metadata) and source tag
    of every row; how many rows of a state carry them."""
    from plotline.operators.clean import lineage_columns
    from plotline.sources.listings import read_listings_csv, write_listings_csv
    from plotline.session import scratch_path
    path = scratch_path(spark, f"landing/{P.sf_key(spark, sf)}/listings_csv_lineage")
    write_listings_csv(P.raw(spark, sf), path)
    df = lineage_columns(read_listings_csv(spark, path))
    return df.groupBy("data_source", "state").agg(
        F.count(F.lit(1)).alias("listings"), F.count("ingested_at").alias("with_time"),
        F.count_if(F.col("source_file").contains("/listings_csv_lineage/")).alias("from_landing"))


# ------------------------------------------------------------------ cleaning
projection("clean_text", P.bronze_df, ["listing_id", "status", "state", "city"], "bronze")
projection("clean_zip", P.bronze_df, ["listing_id", "zip_code"], "bronze")
projection("clean_date", P.bronze_df, ["listing_id", "prev_sold_date"], "bronze")
projection("bronze", P.bronze_df, ["listing_id", *RAW], "bronze")

# ------------------------------------------------------------------- filters
projection("filter_price_range", P.bronze_df, ["listing_id", "price"], "bronze",
           "price BETWEEN 10000 AND 50000000", SV.price_in_range)
projection("filter_null_or_range", P.bronze_df, ["listing_id", "house_size", "bed", "bath", "acre_lot"], "bronze",
           "(house_size IS NULL OR house_size BETWEEN 100 AND 30000) AND (bed IS NULL OR bed <= 20) "
           "AND (bath IS NULL OR bath <= 20) AND (acre_lot IS NULL OR acre_lot <= 1000)",
           lambda: (SV.null_or_range("house_size", C.SQFT_MIN, C.SQFT_MAX) & SV.null_or_range("bed", None, C.BEDS_MAX)
                    & SV.null_or_range("bath", None, C.BATHS_MAX)
                    & SV.null_or_range("acre_lot", None, C.ACRE_LOT_MAX)))
projection("filter_in_set", P.bronze_df, ["listing_id", "status"], "bronze",
           "status IN ('for_sale', 'sold', 'ready_to_build')", lambda: F.col("status").isin(*C.VALID_STATUSES))
projection("filter_required", P.bronze_df, ["listing_id", "state", "zip_code"], "bronze",
           "state IS NOT NULL AND zip_code IS NOT NULL",
           lambda: F.col("state").isNotNull() & F.col("zip_code").isNotNull())

SPLIT_COLS = ["listing_id", "status", "quality_score", "house_size", "property_type", "state_tier"]
projection("split_sold", P.sold_df, SPLIT_COLS, "sold")
projection("split_active", P.active_df, SPLIT_COLS, "active")
projection("split_all", P.all_df, SPLIT_COLS, "all_listings")
projection("filter_training", P.prop_df, ["listing_id", "price", "quality_score", "property_type"], "prop",
           "price BETWEEN 10000 AND 50000000 AND quality_score >= 0.6 AND property_type <> 'LAND'",
           lambda: SV.price_in_range() & (F.col("quality_score") >= 0.6) & (F.col("property_type") != "LAND"))
projection("filter_rent_training", P.prop_df, ["listing_id", "census_median_gross_rent", "quality_score"], "prop",
           "census_median_gross_rent BETWEEN 200 AND 10000 AND quality_score >= 0.6",
           lambda: F.col("census_median_gross_rent").between(C.RENT_TRAIN_MIN, C.RENT_TRAIN_MAX)
           & (F.col("quality_score") >= 0.6))
projection("filter_prior_sale", P.all_df, ["listing_id", "prev_sold_date", "has_prior_sale"], "all_listings",
           "has_prior_sale = 1", lambda: F.col("has_prior_sale") == 1)
projection("filter_not_null_all", P.active_df, ["listing_id", "price", "property_type", "state"], "active",
           "price IS NOT NULL AND property_type IS NOT NULL AND state IS NOT NULL",
           lambda: F.col("price").isNotNull() & F.col("property_type").isNotNull() & F.col("state").isNotNull())


@register("drop_null_subset", O.with_base(
    f"SELECT {sel(['listing_id', 'years_since_last_sale'])} FROM lead WHERE years_since_last_sale IS NOT NULL"))
def q_drop_null_subset(spark, sf):
    """P-12."""
    return P.rounded(P.lead_df(spark, sf).na.drop(subset=["years_since_last_sale"])
                     .select("listing_id", "years_since_last_sale"))



@register("holdout_by_group", O.with_base(
    f"SELECT listing_id, state, {O.r('price')} AS price, CASE WHEN state IN ("
    + ", ".join(O.q(s) for s in C.AVM_TEST_STATES) + ") THEN 'test' ELSE 'train' END AS side FROM prop"))
def q_holdout_by_group(spark, sf):
    """P-16: both sides of the split by held-out states."""
    test = F.col("state").isin(*C.AVM_TEST_STATES)
    prop = P.prop_df(spark, sf).select("listing_id", "state", "price")
    train, held = prop.filter(~test).withColumn("side", F.lit("train")), prop.filter(test).withColumn("side", F.lit("test"))
    return P.rounded(train.unionByName(held))


# ------------------------------------------------------------ derived columns
projection("price_per_sqft", P.silver_df, ["listing_id", "price_per_sqft"], "silver")
projection("property_type", P.silver_df, ["listing_id", "property_type"], "silver")
projection("ratio_features", P.silver_df, ["listing_id", "bath_bed_ratio", "lot_sqft", "lot_to_living_ratio"],
           "silver")
projection("years_since", P.silver_df, ["listing_id", "years_since_last_sale", "has_prior_sale"], "silver")
projection("buckets", P.silver_df, ["listing_id", "sqft_bucket", "price_tier"], "silver")
projection("quality_score", P.silver_df, ["listing_id", "quality_score"], "silver")
projection("join_tier_dim", P.silver_df, ["listing_id", "state", "state_tier"], "silver")
projection("join_census", P.silver_df, ["listing_id", "zip_code", *C.CENSUS_COLUMNS], "silver")
projection("silver", P.silver_df,
           ["listing_id", *RAW, "price_per_sqft", "property_type", "bath_bed_ratio", "lot_sqft",
            "lot_to_living_ratio", "years_since_last_sale", "has_prior_sale", "sqft_bucket", "price_tier",
            "state_tier", "quality_score", *C.CENSUS_COLUMNS], "silver")


@register("null_columns", O.with_base(
    "SELECT listing_id, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in C.CENSUS_COLUMNS) + " FROM valid"))
def q_null_columns(spark, sf):
    """P-28: the census columns as typed nulls when no census data exists."""
    from plotline.sources.census import null_census_columns
    df = SV.filter_valid(P.bronze_df(spark, sf))
    return null_census_columns(df).select("listing_id", *C.CENSUS_COLUMNS)


IND = ["tier_coastal", "tier_sun_belt", "tier_midwest", "is_multi_family", "is_condo", "is_rural",
       "has_census_data", "sqft_micro", "sqft_small", "sqft_medium", "sqft_large", "sqft_xlarge"]
projection("indicator_columns", P.prop_df, ["listing_id", *IND], "prop")
projection("context_ratios", P.prop_df, ["listing_id", "price_vs_zip_median", "affordability_ratio",
                                         "absorption_proxy"], "prop")
projection("join_zip_context", P.prop_df, ["listing_id", *FE.ZIP_CONTEXT], "prop")
projection("gold_property", P.prop_df, ["listing_id", *RAW, "property_type", "state_tier", "quality_score",
                                        *FE.ZIP_CONTEXT, "price_vs_zip_median", "affordability_ratio",
                                        "absorption_proxy", *IND], "prop")

HOLD = ["hold_0_2", "hold_2_5", "hold_5_10", "hold_10_plus", "long_hold", "very_long_hold"]
LEAD_IND = ["high_unrealized_gain", "in_sellers_market", "large_lot", "small_unit", "high_vacancy_area",
            "high_unemployment_area", "tier_coastal", "tier_sun_belt", "tier_midwest", "is_condo", "is_rural",
            "is_multi_family"]
projection("hold_buckets", P.lead_df, ["listing_id", "years_since_last_sale", *HOLD], "lead")
projection("hindsight_gain", P.lead_df, ["listing_id", "approx_purchase_price", "unrealized_gain_est",
                                         "unrealized_gain_pct"], "lead")
projection("lead_indicators", P.lead_df, ["listing_id", *LEAD_IND], "lead")
projection("join_lead_context", P.lead_df, ["listing_id", *FE.LEAD_CONTEXT], "lead")
projection("gold_lead", P.lead_df, ["listing_id", *RAW, "property_type", "state_tier", *FE.LEAD_CONTEXT,
                                    "approx_purchase_price", "unrealized_gain_est", "unrealized_gain_pct",
                                    *HOLD, *LEAD_IND], "lead")

_REQ_YEARS = "coalesce(TRY_CAST(trim(CAST(years_since_last_sale AS VARCHAR)) AS DOUBLE), 0.0)"


@register("hold_buckets_request", O.with_base(
    "SELECT listing_id, "
    f"CASE WHEN {_REQ_YEARS} < 2 THEN 1 ELSE 0 END AS hold_0_2, "
    f"CASE WHEN {_REQ_YEARS} >= 2 AND {_REQ_YEARS} < 5 THEN 1 ELSE 0 END AS hold_2_5, "
    f"CASE WHEN {_REQ_YEARS} >= 5 AND {_REQ_YEARS} < 10 THEN 1 ELSE 0 END AS hold_5_10, "
    f"CASE WHEN {_REQ_YEARS} >= 10 THEN 1 ELSE 0 END AS hold_10_plus, "
    f"CASE WHEN {_REQ_YEARS} >= 10 THEN 1 ELSE 0 END AS long_hold, "
    f"CASE WHEN {_REQ_YEARS} >= 15 THEN 1 ELSE 0 END AS very_long_hold FROM silver"))
def q_hold_buckets_request(spark, sf):
    """P-26: request-form buckets (half-open; missing years count as 0)."""
    return P.silver_df(spark, sf).select("listing_id", *[c.alias(k) for k, c in FE.hold_buckets_request().items()])


@register("address_key", O.with_base(
    "SELECT listing_id, concat_ws('|', street, city, state) AS addr_skip_null, "
    "concat_ws('|', coalesce(street, ''), coalesce(city, ''), coalesce(state, '')) AS addr_keep_null FROM silver"))
def q_address_key(spark, sf):
    """P-34: both address key forms."""
    return P.silver_df(spark, sf).select(
        "listing_id", X.address_key_skip_null("street", "city", "state").alias("addr_skip_null"),
        X.address_key_keep_null("street", "city", "state").alias("addr_keep_null"))


@register("coalesce_default", O.with_base(
    f"SELECT DISTINCT s.state, s.state_tier, coalesce(y.gross_yield, CAST({C.DEFAULT_GROSS_YIELD} AS DOUBLE)) AS gross_yield "
    f"FROM silver s LEFT JOIN {O.YIELD_DIM} y ON s.state = y.state"))
def q_coalesce_default(spark, sf):
    """P-42: tier and yield defaults after left joins to the literal dims."""
    from plotline.operators.invest import with_state_yield
    return P.rounded(with_state_yield(P.silver_df(spark, sf).select("state", "state_tier").distinct())
                     .select("state", "state_tier", "gross_yield"))


@register("project_rename", O.with_base(f"SELECT {sel(['state', 'zip_code', *FE.ZIP_CONTEXT])} FROM zip_ctx"))
def q_project_rename(spark, sf):
    """P-44: the SFR zip context projection."""
    return P.rounded(FE.zip_context(P.market_df(spark, sf)))


# --------------------------------------------------------------- address sets
@register("distinct_addresses", O.with_base("SELECT a FROM sold_addr"))
def q_distinct_addresses(spark, sf):
    """S-13 / G-9: distinct address keys of sold listings."""
    return FE.address_set(P.sold_df(spark, sf))


@register("distinct_keys", O.with_base("SELECT DISTINCT state, zip_code, property_type FROM silver"))
def q_distinct_keys(spark, sf):
    """G-9: distinct segment keys."""
    return P.silver_df(spark, sf).select("state", "zip_code", "property_type").distinct()


@register("intersect_addresses", O.with_base("SELECT a FROM relisted"))
def q_intersect_addresses(spark, sf):
    """T-1: addresses both sold and for sale."""
    s = P.silver_df(spark, sf)
    return FE.relisted_addresses(SV.sold_listings(s), SV.active_listings(s))


@register("semi_relisted", O.with_base("SELECT listing_id, relisted FROM lead_labeled"))
def q_semi_relisted(spark, sf):
    """J-9: the relisted flag on lead rows (keep-null key against the set)."""
    return P.lead_labeled_df(spark, sf).select("listing_id", "relisted")


@register("motivated_label", O.with_base("SELECT listing_id, relisted, motivated_seller FROM lead_labeled"))
def q_motivated_label(spark, sf):
    """M-10."""
    return P.lead_labeled_df(spark, sf).select("listing_id", "relisted", "motivated_seller")


@register("union_results", O.with_base(
    "SELECT 'sold' AS part, listing_id FROM sold UNION ALL SELECT 'active' AS part, listing_id FROM active"))
def q_union_results(spark, sf):
    """T-2: per-part results concatenated by name."""
    s = P.silver_df(spark, sf)
    a = SV.sold_listings(s).select(F.lit("sold").alias("part"), "listing_id")
    b = SV.active_listings(s).select("listing_id", F.lit("active").alias("part"))
    return a.unionByName(b)


@register("head_n", O.with_base(
    f"SELECT {sel(['listing_id', 'state', 'price'])} FROM prop "
    "WHERE state IN (" + ", ".join(O.q(s) for s in C.AVM_TEST_STATES) + ") ORDER BY listing_id LIMIT 2"))
def q_head_n(spark, sf):
    """T-3: the first two held-out rows (an example input), ordered by id."""
    df = P.prop_df(spark, sf).filter(F.col("state").isin(*C.AVM_TEST_STATES))
    return P.rounded(df.orderBy("listing_id").limit(2).select("listing_id", "state", "price"))


_LATEST_SALE = O.with_base(
    "SELECT a, latest_sale, max(listing_id) AS listing_id FROM ("
    "SELECT concat_ws('|', street, city, state) AS a, prev_sold_date, listing_id, "
    "max(prev_sold_date) OVER (PARTITION BY concat_ws('|', street, city, state)) AS latest_sale "
    "FROM silver WHERE prev_sold_date IS NOT NULL) t WHERE prev_sold_date = latest_sale GROUP BY a, latest_sale")


@register("latest_version", _LATEST_SALE)
def q_latest_version(spark, sf):
    """T-4: the latest row per key (here the latest sale per address). A
    max over (version, id) structs is a partial aggregate, so a hot key is
    combined map-side instead of sorted in one task."""
    df = P.silver_df(spark, sf).filter(F.col("prev_sold_date").isNotNull())
    best = F.max(F.struct("prev_sold_date", "listing_id"))
    return (df.groupBy(X.address_key_skip_null("street", "city", "state").alias("a"))
            .agg(best.alias("b"))
            .select("a", F.col("b.prev_sold_date").alias("latest_sale"), F.col("b.listing_id").alias("listing_id")))


@register("latest_sale", _LATEST_SALE)
def q_latest_sale(spark, sf):
    """The latest sale per address: ``latest_version`` under its own name."""
    return q_latest_version(spark, sf)


_LOG = ("log AS (SELECT state AS model, CAST(year(prev_sold_date) AS INTEGER) AS version, "
        "count_if(price >= 300000) / count(*) >= 0.5 AS passed FROM silver WHERE prev_sold_date IS NOT NULL AND state IS NOT NULL GROUP BY ALL)")


def _version_log(spark, sf):
    """A version log derived from the listings: a model for each state, a version for each year of sales, gated by the
    share of listings at 300,000 or more."""
    sold = P.silver_df(spark, sf).filter("prev_sold_date is not null and state is not null")
    share = F.count_if(F.col("price") >= 300_000) / F.count(F.lit(1))
    return (sold.groupBy(F.col("state").alias("model"), F.year("prev_sold_date").alias("version")).agg(share.alias("value"))
            .withColumn("passed", F.col("value") >= 0.5))


@register("latest_model_version", O.with_base("SELECT model, max(version) AS version FROM log GROUP BY model", _LOG))
def q_latest_model_version(spark, sf):
    """T-4: the latest version of every model of a version log."""
    from plotline.plans.versions import latest
    return latest(_version_log(spark, sf))


@register("model_promotion", O.with_base(
    "SELECT model, version, CASE WHEN NOT passed THEN 'rejected' WHEN version = max(CASE WHEN passed THEN version END) OVER "
    "(PARTITION BY model) THEN 'production' ELSE 'archived' END AS state FROM log", _LOG))
def q_model_promotion(spark, sf):
    """T-4 + E-6: the latest version that passed its gate is in production, earlier ones are archived."""
    from plotline.plans.versions import states
    return states(_version_log(spark, sf))


@register("key_uniqueness", O.with_base(
    "SELECT street, city, state, zip_code, count(*) AS n FROM prop GROUP BY ALL HAVING count(*) > 1"))
def q_key_uniqueness(spark, sf):
    """K-8: duplicate-key report for the property feature table's keys."""
    from plotline.operators.quality import duplicate_keys
    return duplicate_keys(P.prop_df(spark, sf), C.ADDRESS_KEYS)
