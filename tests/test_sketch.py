"""Row differences from a sketch, against the count of all row hashes and against SQL."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.operators import compare as C
from concord.operators import sketch


def diffed(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


def test_equal_sides(spark, sf_dir):
    df = lines(spark, sf_dir)
    assert C.row_diff(df, df.select(*reversed(df.columns)).repartition(5)).collect() == []


@pytest.mark.parametrize("changed", [1, 7, 60, 1_000])
def test_some_rows_differ(spark, changed):
    # a sketch is made where the difference is a small part of the rows
    df = lines(spark, "/root/testdata/sf0.01" if changed > 100 else "/root/testdata/sf0.001")
    at = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(df.count() // changed)) == 0
    other = df.withColumn("l_quantity", F.col("l_quantity") + F.when(at, 0.5).otherwise(0.0))
    mine = C.row_diff(df, other)
    assert diffed(mine) == diffed(C.row_diff(df, other, sketch_rows=0)) and mine.count() > 1
    assert sketch.difference(*[hashed(x) for x in (df, other)]) is not None


def hashed(df):
    return df.select(F.xxhash64(*df.columns).alias("h1"), F.xxhash64(F.lit(1), *df.columns).alias("h2"))


def test_all_rows_differ_and_the_count_takes_over(spark, sf_dir):
    df = lines(spark, sf_dir)
    other = df.withColumn("l_quantity", F.col("l_quantity") + 0.5)
    assert sketch.difference(hashed(df), hashed(other), 100) is None
    assert diffed(C.row_diff(df, other, sketch_rows=100)) == diffed(C.row_diff(df, other, sketch_rows=0))
    assert C.row_diff(df, df.limit(0)).agg(F.sum("copies")).first()[0] == df.count()


def test_copies_count(spark):
    left = spark.createDataFrame([("a",)] * 5 + [("b",)] * 300 + [("c",)] * 2, "v string").repartition(3)
    right = spark.createDataFrame([("a",)] * 7 + [("b",)] * 1 + [("c",)] * 2 + [(None,)], "v string").repartition(2)
    assert diffed(C.row_diff(left, right)) == Counter({("right", "2", "a"): 1, ("left", "299", "b"): 1, ("right", "1", "None"): 1})


def test_a_failed_peeling_is_noticed():
    class Cell:
        def __init__(self, cell, n, h1, h2, check):
            self.cell, self.n, (self.c0, self.c1) = cell, n, (check & 0x1FFFFF, check >> 21)
            (self.a0, self.a1, self.a2), (self.b0, self.b1, self.b2) = [(h & 0x1FFFFF, h >> 21 & 0x1FFFFF, h >> 42) for h in (h1, h2)]

    def cells(rows, size):
        held = {}
        for h1, h2, n in rows:
            for place in sketch._own_cells(h1, h2, size):
                old = held.get(place, (0, 0, 0, 0))
                held[place] = [o + n * x for o, x in zip(old, (1, h1, h2, sketch._check(h1, h2)), strict=True)]
        return [Cell(p, *v) for p, v in held.items()]

    some = random.Random(3)
    rows = [(some.getrandbits(64) - (1 << 63), some.getrandbits(64) - (1 << 63), some.choice([-3, -1, 1, 2, 9])) for _ in range(500)]
    assert sketch.peel(cells(rows, 400), 400) == ({(a, b): n for a, b, n in rows}, True)
    found, whole = sketch.peel(cells(rows, 60), 60)
    assert not whole and found.items() <= {(a, b): n for a, b, n in rows}.items()


def test_no_rows_are_exchanged(spark, sf_dir):
    df = lines(spark, sf_dir)
    other = df.where("l_orderkey % 1000 <> 3")
    diff = C.row_diff(df, other)
    diff.collect()
    plan = diff._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    assert "hashpartitioning(h1" not in final


def test_columns_of_one_side(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(1, "a", "x")], "k int, v string, w string")
    for a, b in ((left, right), (right, left)):
        with pytest.raises(ValueError, match="w .*missing"):
            C.row_diff(a, b)
    assert C.row_diff(left, right, columns=C.common_columns(left, right)).collect() == []
    with pytest.raises(ValueError, match="k .int / bigint"):
        C.row_diff(left, left.withColumn("k", F.col("k").cast("bigint")))


CLASHING = ["side", "copies", "a.b", "left_n", "right_n", "h1", "h2", "c0", "c1", "__l", "__r", "by0", "k0", "l_n", "l1", "left_rows", "present_in"]


@pytest.mark.parametrize("by", [[], ["a.b", "l1", "left_rows"]])
def test_columns_named_like_those_of_the_operator(spark, by):
    rows = [tuple(f"{c}{i}" for c in CLASHING) for i in range(5)]
    schema = ", ".join(f"`{c}` string" for c in CLASHING)
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[1:], schema)
    diff = C.row_diff(left, right, by)
    assert diff.columns == ["side_", "copies_", *CLASHING]
    assert [tuple(r) for r in diff.collect()] == [("left", 1, *rows[0])]
    coverage = C.coverage_diff(left, right, ["a.b", "left_n", "present_in"])
    assert [tuple(r) for r in coverage.collect()] == [("a.b0", "left_n0", "present_in0", "left")]
    assert C.coverage_diff(left, right, ["a.b"]).columns == ["a.b", "present_in"]
    groups = C.partition_level_compare(left, right, ["left_rows", "k0"])
    assert [tuple(r) for r in groups.collect()] == [("left_rows0", "k00", 1, 0)]
    assert groups.columns == ["left_rows", "k0", "left_rows_", "right_rows"]


def test_unknown_predicates(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "q int")
    assert [tuple(r) for r in C.invariants(df, {"positive": F.col("q") > 0}).collect()] == [("positive", 1, 1)]
