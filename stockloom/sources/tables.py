"""Reading and writing the log and the normalized tables as Parquet."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instant
from ..schemas import LOG, SHOP_DESCRIPTIONS, TABLE_SCHEMAS, Tables


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The single-table log with its derived profit column."""
    log = spark.read.schema(LOG).parquet(path)
    return log.withColumn("gross_profit", (F.col("sell_price") - F.col("stock_cost_price")).cast("decimal(10,2)"))


def read_tables(spark: SparkSession, path: str) -> Tables:
    return Tables(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in TABLE_SCHEMAS.items()})


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns in the order and types of the table schema; absent ones become null."""
    schema = TABLE_SCHEMAS[name]
    return df.select(
        *((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)
    )


def write_tables(tables: Tables, root: str) -> str:
    """Write a new version below ``root`` and make it current. The version being read is never touched."""
    spark = tables.items.sparkSession
    version = latest_version(spark, root) + 1
    path = f"{root}/v{version:08d}"
    for name in Tables.names():
        conform(getattr(tables, name), name).write.mode("overwrite").parquet(f"{path}/{name}")
    # The version counts only once all its tables are written.
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{root}/versions")
    return path


def latest_version(spark: SparkSession, root: str) -> int:
    try:
        versions = spark.read.schema("version int").parquet(f"{root}/versions")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    return versions.agg(F.max("version")).first()[0] or 0


def current_tables(spark: SparkSession, root: str) -> Tables:
    version = latest_version(spark, root)
    if not version:
        raise ValueError(f"no tables below {root}")
    return read_tables(spark, f"{root}/v{version:08d}")


def shops(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """The two shops; rows already known keep their description."""
    seed = spark.createDataFrame(list(SHOP_DESCRIPTIONS), "shop_code string, description string")
    if known is None:
        return seed
    return known.unionByName(seed.join(known.select("shop_code"), "shop_code", "left_anti"))


def archive_history(
    history: DataFrame, path: str, period: str = "day", since: dt.datetime | None = None, until: dt.datetime | None = None,
) -> None:
    """Write the audit trail of [since, until) to an archive laid out by shop and day (or another ``date_trunc`` period).

    The history only grows, so a period that is written again is replaced by the same rows or more: a rerun leaves the
    archive as it is, and periods outside the range are not touched. The bounds must not cut a period in two.
    """
    spark = history.sparkSession
    for bound in (since, until):
        if bound is not None and spark.range(1).select(F.date_trunc(period, F.lit(bound)) == F.lit(bound)).first()[0] is not True:
            raise ValueError(f"{bound} is not the start of a {period}")
    rows = history
    if since is not None:
        rows = rows.where(F.col("created_at") >= instant(since))
    if until is not None:
        rows = rows.where(F.col("created_at") < instant(until))
    dated = rows.withColumn("period", F.date_trunc(period, F.col("created_at")).cast("date"))
    # Rows of a folder are brought together, but a period with very many rows is split over several writers.
    spread = dated.hint("rebalance", "shop_type", "period")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shop_type", "period").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
