"""Raw listing sources: the CSV scan and the adapter over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.config import ADAPTER_AS_OF

# The 12-field raw listing schema (all nullable).
LISTING_SCHEMA = T.StructType([
    T.StructField("brokered_by", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("bed", T.DoubleType(), True),
    T.StructField("bath", T.DoubleType(), True),
    T.StructField("acre_lot", T.DoubleType(), True),
    T.StructField("street", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("zip_code", T.StringType(), True),
    T.StructField("house_size", T.DoubleType(), True),
    T.StructField("prev_sold_date", T.StringType(), True),
])
RAW_COLUMNS = [f.name for f in LISTING_SCHEMA.fields]

# State names given to nation keys 0..24 by the adapter.
ADAPTER_STATES = [
    "California", "New York", "Hawaii", "Massachusetts", "Washington", "Maryland", "Oregon",
    "Florida", "Texas", "Arizona", "Colorado", "Nevada", "Georgia", "Utah", "Montana",
    "Illinois", "Ohio", "Michigan", "Iowa", "Pennsylvania", "Virginia", "Maine", "Alaska",
    "Vermont", "Wyoming",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_listings_csv(spark: SparkSession, path: str, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """Header CSV with a declared schema; empty string is null; a value that
    does not parse becomes null and the row is kept."""
    return (spark.read.format("csv")
            .option("header", "true")
            .option("nullValue", "")
            .option("mode", "PERMISSIVE")
            .schema(schema)
            .load(path))


def write_listings_csv(df: DataFrame, path: str) -> None:
    """Land listings as a header CSV, keeping leading/trailing blanks and
    writing null as an empty field."""
    (df.write.mode("overwrite").option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path))


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def adapter_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 12-column listings derived from lineitem, orders, customer, nation, part.

    One listing per lineitem row. orders and customer are joined first (the
    narrow pair), then lineitem is joined to it and to part, so lineitem is
    shuffled once per key it needs. nation (25 rows by definition) is left to
    the planner, which broadcasts it by its measured size.

    lineitem and orders are joined by a shuffle at every size: a broadcast
    join leaves all work on a row group's rows, and the files of every layer
    after it, to the one task that reads the group.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")

    order_ctx = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                 .join(nation, F.col("c_nationkey") == nation.n_nationkey)
                 .select("o_orderkey", "o_custkey", "c_nationkey", "n_name"))
    j = (li.join(order_ctx.hint("merge"), li.l_orderkey == order_ctx.o_orderkey)
         .join(part, li.l_partkey == part.p_partkey))
    return j.select(*adapter_columns())


def adapter_columns() -> list[Column]:
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    states = F.array(*[F.lit(s.upper()) for s in ADAPTER_STATES])
    status = (F.when(F.col("l_returnflag") == "A", F.lit(" For_Sale "))
              .when(F.col("l_returnflag") == "R", F.lit("SOLD"))
              .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit("ready_to_build"))
              .otherwise(F.lit("pending")))
    offset_days = ((F.col("l_orderkey") * 37 + pk * 11) % 7300).cast("int")
    sold = F.date_sub(F.lit(ADAPTER_AS_OF), offset_days).cast("string")
    prev = (F.when(sk % 5 == 0, F.lit(None).cast("string"))
            .when(sk % 29 == 0, F.lit("2023-02-30"))
            .when(sk % 37 == 0, F.lit("3019-04-02"))
            .otherwise(sold))
    return [
        sk.cast("string").alias("brokered_by"),
        status.alias("status"),
        _null_if(pk % 97 == 0, F.col("l_extendedprice") * 10).cast("double").alias("price"),
        _null_if(pk % 11 == 0, (F.col("p_size") % 7).cast("double")).alias("bed"),
        _null_if(pk % 13 == 0, F.col("l_linenumber").cast("double")).alias("bath"),
        _null_if(sk % 7 == 0, F.col("l_discount") * 60).cast("double").alias("acre_lot"),
        _null_if(sk % 23 == 0, F.concat((pk % 150).cast("string"), F.lit(" Main St"))).alias("street"),
        _null_if(pk % 31 == 0, F.lower(F.col("n_name"))).alias("city"),
        F.element_at(states, F.col("c_nationkey") + 1).alias("state"),
        F.concat((F.lit(600) + F.col("c_nationkey") * 400 + F.col("o_custkey") % 4).cast("string"),
                 F.lit(".0")).alias("zip_code"),
        _null_if(pk % 17 == 0, F.col("l_quantity") * 80).cast("double").alias("house_size"),
        prev.alias("prev_sold_date"),
    ]
