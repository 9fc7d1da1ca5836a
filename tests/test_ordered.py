import random

import pytest
from pyspark.sql import functions as F

from stockloom.operators.ordered import global_row_number, key_splits, running


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One key holds most of the rows, and a third of those share one time.
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.choice([5, rng.randrange(40)]), i,
             rng.choice([None, rng.randrange(-9, 9)])) for i in range(400)]


def expected(rows, latest_first):
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]), reverse=latest_first)
        total, last = None, None
        for _, at, seq, value in group:
            before = last
            if value is not None:
                total, last = (total or 0) + value, value
            out[seq] = (total, before)
    return out


@pytest.mark.parametrize("share", [10**9, 2.0, 0.01])
@pytest.mark.parametrize("latest_first", [False, True])
def test_running(spark, rows, share, latest_first):
    df = spark.createDataFrame(rows, "k string, at int, seq int, v int").repartition(5)
    got = running(df, ["k"], ["at", "seq"], sums={"total": F.col("v")}, lasts={"before": F.col("v")},
                  latest_first=latest_first, share=share).collect()
    assert {r.seq: (r.total, r.before) for r in got} == expected(rows, latest_first)
    assert len(got) == len(rows)


def test_running_of_nothing(spark):
    df = spark.createDataFrame([], "k string, at int, seq int, v int")
    assert running(df, ["k"], ["at", "seq"], sums={"total": F.col("v")}).collect() == []


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield 32
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_key_with_all_rows_is_spread(spark, many_partitions):
    # All rows of one import share one time.
    rows = [("k", 5, i, i % 7) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, at int, seq int, v int").repartition(5)
    cuts = key_splits(df, ["k"], ["at", "seq"]).collect()
    assert [r.k for r in cuts] == ["k"] and 24 <= len(cuts[0]["_cuts"]) <= 42
    edges = [0, *(c.seq for c in cuts[0]["_cuts"]), len(rows)]
    assert max(b - a for a, b in zip(edges, edges[1:])) < 3 * len(rows) / many_partitions
    got = running(df, ["k"], ["at", "seq"], sums={"total": F.col("v")}, lasts={"before": F.col("v")}).collect()
    assert {r.seq: (r.total, r.before) for r in got} == expected(rows, False)


def test_more_split_keys_than_partitions(spark, rows):
    many = [(f"k{i % 9}", i // 50, i, i % 5 or None) for i in range(3_600)]
    df = spark.createDataFrame(many, "k string, at int, seq int, v int").repartition(6)
    assert key_splits(df, ["k"], ["at", "seq"], 0.01).count() == 9
    got = running(df, ["k"], ["at", "seq"], sums={"total": F.col("v")}, lasts={"before": F.col("v")}, share=0.01).collect()
    assert {r.seq: (r.total, r.before) for r in got} == expected(many, False)


def test_even_keys_are_not_split(spark):
    df = spark.range(4_000).select(F.concat(F.lit("k"), F.col("id") % 100).alias("k"), F.col("id").alias("at"))
    assert key_splits(df, ["k"], ["at"]) is None


def test_global_row_number(spark, rows):
    df = spark.createDataFrame(rows, "k string, at int, seq int, v int").repartition(6)
    got = {r.seq: r.id for r in global_row_number(df, ["at", "seq"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: n for n, r in enumerate(ordered, 1)}
