import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom.functions import days_until, is_overdue, margin_pct, normalize_sku, number_prefix, whole_prefix

NUMBERS = {
    "12.50kg": ("12.50", False), "abc": ("0", False), "": ("0", False), None: ("0", False), " 7": ("7", False),
    "-1": ("-1", False), ".5": ("0.5", False), "1e3": ("1000", False), "3.": ("3", False), "1.005": ("1.01", False),
    "100000000": ("0", True), "99999999.994": ("99999999.99", False), "99999999.995": ("0", True),
    "1e40": ("0", True), "Infinity": ("0", True), "+4x": ("4", False), "-": ("0", False),
}
WHOLES = {
    "3.7": (3, False), "5abc": (5, False), "": (None, False), None: (None, False), "-2": (-2, False), "x": (None, False),
    "0x1f": (31, False), "2147483648": (None, True), "2147483647": (2147483647, False), " 8": (8, False),
    "1" * 45: (None, True),
}


def test_number_prefix(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    value, big = number_prefix(F.col("t"))
    got = {r.t: (r.v, r.b) for r in df.select("t", value.alias("v"), big.alias("b")).collect()}
    assert got == {k: (Decimal(v), b) for k, (v, b) in NUMBERS.items()}


def test_whole_prefix(spark):
    df = spark.createDataFrame([(k,) for k in WHOLES], "t string")
    value, big = whole_prefix(F.col("t"))
    assert {r.t: (r.v, r.b) for r in df.select("t", value.alias("v"), big.alias("b")).collect()} == WHOLES


def test_sku_and_margin(spark):
    row = spark.sql("SELECT '\t ab-1  ' AS s, 3.00BD AS sell, 1.00BD AS cost, 0.00BD AS free").select(
        normalize_sku(F.col("s")).alias("s"), margin_pct(F.col("sell"), F.col("cost")).alias("m"),
        margin_pct(F.col("free"), F.col("cost")).alias("z"),
    ).first()
    assert (row.s, row.m, row.z) == ("AB-1", Decimal("66.67"), Decimal("0.00"))


def test_due_days(spark):
    noon, midnight = dt.datetime(2001, 6, 1, 12), dt.datetime(2001, 6, 1)
    df = spark.sql("SELECT explode(array(DATE'2001-05-30', DATE'2001-06-01', DATE'2001-06-03', CAST(NULL AS DATE))) AS d")
    got = [tuple(r) for r in df.select(
        days_until(F.col("d"), noon), is_overdue(F.col("d"), noon), is_overdue(F.col("d"), midnight)
    ).collect()]
    # Due today is overdue once the day has begun.
    assert got == [(-2, True, True), (0, True, False), (2, False, False), (None, False, False)]
