"""Census enrichment: landed ACS responses (JSON array of arrays, first row is
the header) parsed into one row per zip code tabulation area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import config as C
from plotline.functions.columns import round_half_up_ratio
from plotline.sources.listings import ADAPTER_STATES, read_table

CENSUS_HEADER = ["NAME", *C.CENSUS_VARIABLES, C.CENSUS_ZIP_FIELD]


def read_census_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed response file (column ``doc``). A response covers one
    request (a state's zips), so a file is read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))


def parse_census(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Response documents -> one row per zip with counts and five rates.

    Each document carries its own header, so documents from different
    requests can be parsed together. Missing or non-numeric values count
    as 0; a rate is round(numerator / max(denominator, 1), 4).
    """
    parsed = docs.select(F.from_json(F.col(doc_col), "array<array<string>>").alias("a"))
    rows = (parsed
            .select(F.element_at("a", 1).alias("header"), F.posexplode(F.col("a")).alias("pos", "row"))
            .filter(F.col("pos") > 0))

    def field(name: str) -> Column:
        p = F.array_position(F.col("header"), name).cast("int")
        return F.when(p > 0, F.try_element_at(F.col("row"), p))

    def as_int(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("long"), F.lit(0).cast("long"))

    raw = rows.select(field(C.CENSUS_ZIP_FIELD).alias("zip_code"),
                      *[field(v).alias(v) for v in C.CENSUS_VARIABLES])
    out = [F.coalesce(F.col("zip_code"), F.lit("")).alias("zip_code")]
    out += [as_int(v).alias(name) for name, v in C.CENSUS_COUNT_COLUMNS.items()]
    out += [round_half_up_ratio(as_int(n), F.greatest(as_int(d), F.lit(1).cast("long")), 4).alias(name)
            for name, (n, d) in C.CENSUS_RATE_COLUMNS.items()]
    return raw.select(*out)


def null_census_columns(df: DataFrame) -> DataFrame:
    """The enrichment columns as typed nulls (used when no census data exists)."""
    return df.withColumns({c: F.lit(None).cast("double") for c in C.CENSUS_COLUMNS})


def join_census(df: DataFrame, census: DataFrame | None) -> DataFrame:
    """Left join on zip_code (the planner broadcasts census if it is small)."""
    if census is None:
        return null_census_columns(df)
    return df.join(census, "zip_code", "left")


# ------------------------------------------------------- fixture documents
def census_fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census values for every zip the listings adapter produces (FIXTURES.md §2),
    derived from customer: zip z = 600 + 400 * nation + custkey % 4; zips with
    z % 13 = 0 are left out so the join also yields nulls."""
    cust = read_table(spark, sf_dir, "customer")
    z = F.col("z")
    zips = (cust.select((F.lit(600) + F.col("c_nationkey") * 400 + F.col("c_custkey") % 4).cast("long").alias("z"),
                        F.col("c_nationkey").alias("nation"))
            .distinct()
            .filter(z % 13 != 0))
    s = lambda e: e.cast("string")
    values = {
        "B19013_001E": F.when(z % 7 == 0, F.lit(None).cast("string"))
                        .when(z % 11 == 0, F.lit("x"))
                        .otherwise(s(30000 + (z * 37) % 90000)),
        "B01003_001E": s(1000 + z % 9000),
        "B25077_001E": s(100000 + (z * 53) % 900000),
        "B25064_001E": s(150 + z % 3000),
        "B17001_002E": s(z % 700),
        "B23025_005E": s(z % 300),
        "B23025_002E": F.when(z % 9 == 0, F.lit("0")).otherwise(s(500 + z % 4000)),
        "B25002_003E": s(z % 200),
        "B25001_001E": s(800 + z % 1500),
        "B25003_002E": s(z % 900),
        "B25003_001E": s(900 + z % 300),
        "B15003_022E": s(z % 600),
        "B15003_001E": s(700 + z % 2000),
    }
    zip5 = F.lpad(s(z), 5, "0")
    return zips.select("nation", "z",
                       F.array(F.concat(F.lit("ZCTA5 "), zip5), *[values[v] for v in C.CENSUS_VARIABLES],
                               zip5).alias("row"))


def land_census_documents(docs: DataFrame, path: str) -> None:
    """Land response documents as text files under one folder per state."""
    docs.select("state", "doc").repartition("state").write.mode("overwrite").partitionBy("state").text(path)


def census_fixture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render the fixture as one response document per state (header first).

    A document holds the zips of one state, so it is bounded by the number
    of zip codes in a state."""
    rows = census_fixture_rows(spark, sf_dir)
    header = F.array(*[F.lit(h) for h in CENSUS_HEADER])
    states = F.array(*[F.lit(x) for x in ADAPTER_STATES])
    docs = (rows.groupBy("nation")
            .agg(F.array_sort(F.collect_list(F.struct("z", "row"))).alias("r"))
            .select(F.element_at(states, F.col("nation") + 1).alias("state"),
                    F.to_json(F.concat(F.array(header), F.transform("r", lambda x: x["row"]))).alias("doc")))
    return docs
