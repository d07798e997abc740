"""Bronze: raw listings -> cleaned listings with lineage columns."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import columns as X
from plotline.sources.listings import RAW_COLUMNS, LISTING_SCHEMA

DATA_SOURCE = "realtor_national_csv"


def listing_id(cols=RAW_COLUMNS, schema=LISTING_SCHEMA) -> Column:
    """Content hash of the raw columns (doubles rendered as the integer
    floor(x * 10^4 + 0.5), null as \\N). Identical raw rows share an id;
    they are interchangeable."""
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    parts = []
    for c in cols:
        v = (F.floor(F.col(c) * 10000.0 + 0.5).cast("string") if types.get(c) == "double" else F.col(c))
        parts.append(F.coalesce(v, F.lit("\\N")))
    return F.md5(F.concat_ws("\u0001", *parts))


def clean_columns(as_of: _dt.date) -> dict[str, Column]:
    """P-17..P-19: text, zip and date cleaning."""
    return {
        "status": X.clean_lower("status"),
        "state": X.clean_title("state"),
        "city": X.clean_title("city"),
        "zip_code": X.clean_zip("zip_code"),
        "prev_sold_date": X.parse_sale_date("prev_sold_date", as_of),
    }


def bronze(raw: DataFrame, as_of: _dt.date, source_file: str | None = None,
           data_source: str = DATA_SOURCE, lineage: bool = True, with_id: bool = True) -> DataFrame:
    """C-1: cleaned raw listings.

    ``lineage`` adds ingested_at, source_file (the scan's file path when not
    given) and data_source; ``with_id`` adds listing_id, a content hash that
    equal raw rows share (so never join on it; carry columns along instead).
    A sale after ``as_of`` (the run's date) is null.
    """
    df = raw
    if with_id:
        df = df.withColumn("listing_id", listing_id())
    if lineage:
        src = F.lit(source_file) if source_file is not None else F.col("_metadata.file_path")
        df = df.withColumns({"ingested_at": F.current_timestamp(), "source_file": src})
    df = df.withColumns(clean_columns(as_of))
    if lineage:
        df = df.withColumn("data_source", F.lit(data_source))
    return df


def lineage_columns(df: DataFrame, source_file: str | None = None, data_source: str = DATA_SOURCE) -> DataFrame:
    """S-4 on its own."""
    src = F.lit(source_file) if source_file is not None else F.col("_metadata.file_path")
    return df.withColumns({"ingested_at": F.current_timestamp(), "source_file": src,
                           "data_source": F.lit(data_source)})
