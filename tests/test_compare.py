import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from concord.operators import compare as C

pytestmark = pytest.mark.usefixtures("interpreted")


def words(spark, rows, schema="word string, count int"):
    return spark.createDataFrame(rows, schema)


def verdict(left, right, **options):
    return C.compare_tables(left, right, **options).first()


def checks(left, right, **options):
    return [(r["check"], r["column"]) for r in C.compare_detail(left, right, **options).orderBy("ord", "column").collect()]


BASE = [("a", 1), ("b", 2), ("c", 3)]


def test_identical(spark):
    row = verdict(words(spark, BASE), words(spark, BASE))
    assert row["matched"] and row["mismatches"] == []


def test_row_order_is_free(spark):
    assert verdict(words(spark, BASE), words(spark, BASE[::-1]))["matched"]


def test_column_order_is_free(spark):
    assert verdict(words(spark, BASE), words(spark, BASE).select("count", "word"))["matched"]


def test_schema(spark):
    right = words(spark, BASE).withColumn("count", F.col("count").cast("string"))
    row = verdict(words(spark, BASE), right)
    assert not row["matched"] and row["mismatches"][0].startswith("schema mismatch")
    assert len(row["mismatches"]) == 1


def test_row_count(spark):
    left, right = words(spark, BASE[:2]).select("word"), words(spark, BASE).select("word")
    assert any("row count mismatch: left=2 right=3" in m for m in verdict(left, right)["mismatches"])


def test_null_count(spark):
    left = words(spark, [("a", 1), (None, 2), ("c", 3)])
    assert ("null_count", "word") in checks(left, words(spark, BASE))


def test_sum_and_max_are_both_reported(spark):
    found = verdict(words(spark, BASE), words(spark, [("a", 1), ("b", 2), ("c", 4)]))["mismatches"]
    assert any(m.startswith("sum('count') mismatch") for m in found)
    assert any(m.startswith("max('count') mismatch") for m in found)
    assert [m.split("(")[0] for m in found[:2]] == ["sum", "max"]


def test_same_sum_and_count_but_other_rows(spark):
    left, right = words(spark, [("a", 1), ("b", 5)]), words(spark, [("a", 2), ("b", 4)])
    assert ("row_content", None) in checks(left, right)


def test_duplicates_are_not_collapsed(spark):
    left, right = words(spark, [("a", 0), ("a", 0), ("b", 0)]), words(spark, [("a", 0), ("b", 0), ("b", 0)])
    assert checks(left, right) == [("row_content", None)]


def test_partition_coverage_only_on_request(spark):
    left, right = words(spark, [("us", 1), ("eu", 2)]), words(spark, [("us", 1), ("apac", 2)])
    assert ("partition_coverage", "word") not in checks(left, right)
    assert ("partition_coverage", "word") in checks(left, right, partition_columns=["word"])


def test_missing_partition_column_is_a_mismatch(spark):
    left, right = words(spark, BASE), words(spark, BASE).drop("count")
    assert ("partition_coverage", "count") in checks(left, right, partition_columns=["count"])


def test_invariants_are_reported_per_side(spark):
    found = C.compare_detail(words(spark, BASE), words(spark, BASE), checks={"small": F.col("count") < 3}).collect()
    assert [(r["column"], r["left"], r["right"]) for r in found if r["check"] == "invariant"] == [
        ("small", "1", None),
        ("small", None, "1"),
    ]


# -- types ------------------------------------------------------------------------------------------------

STAMP = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
TYPED = [
    ("decimal(20,4)", Decimal("1.5000"), Decimal("1.5001")),
    ("timestamp", STAMP, STAMP.replace(microsecond=123457)),
    ("timestamp_ntz", STAMP, STAMP.replace(microsecond=123457)),
    ("date", dt.date(2024, 1, 1), dt.date(2024, 1, 2)),
    ("struct<a:int,b:string>", (1, None), (None, "1")),
    ("array<int>", [1, None], [None, 1]),
    ("array<string>", ["a", "b"], ["a,b"]),
    ("map<string,int>", {"a": 1, "b": 2}, {"a": 2, "b": 1}),
    ("binary", bytearray(b"\x00\x01"), bytearray(b"\x01\x00")),
    ("double", float("nan"), float("inf")),
    ("double", 1e300, -1e300),
    ("double", 0.1, 0.2),
    ("float", 1.5, 2.5),
    ("string", None, ""),
    ("string", "None", None),
    ("string", "é", "é"),
    ("string", "x" * 1_000_000, "x" * 999_999),
    ("bigint", 2**62, 2**62 - 1),
    ("boolean", True, None),
]


@pytest.mark.parametrize("kind,value,other", TYPED, ids=[f"{i}-{t[0]}" for i, t in enumerate(TYPED)])
def test_type(spark, kind, value, other):
    schema = f"id int, v {kind}"
    left = spark.createDataFrame([(1, value), (2, value)], schema)
    same = spark.createDataFrame([(2, value), (1, value)], schema)
    changed = spark.createDataFrame([(1, value), (2, other)], schema)
    assert verdict(left, same)["matched"]
    assert not verdict(left, changed)["matched"]
    assert C.multiset_diff(left, same).count() == 0
    assert C.multiset_diff(left, changed, digest="sha256").count() == 2
    assert C.row_diff(left, changed).count() == 2


def test_null_moves_between_columns(spark):
    schema = "a string, b string"
    left, right = spark.createDataFrame([(None, "x")], schema), spark.createDataFrame([("x", None)], schema)
    assert C.multiset_diff(left, right).count() == 2


def test_map_key_order_and_signed_zero_are_free(spark):
    schema = "m map<string,int>, z double"
    left = spark.createDataFrame([({"a": 1, "b": 2}, 0.0)], schema)
    right = spark.createDataFrame([({"b": 2, "a": 1}, -0.0)], schema)
    assert verdict(left, right)["matched"]


def test_sums_beyond_64_bits_are_exact(spark):
    left = spark.range(6).select(F.lit(2**62).alias("v"))
    assert C.table_profile(left).first()["sum"] == str(6 * 2**62)
    negative = spark.range(6).select((F.lit(-(2**62)) - F.col("id")).alias("v"))
    assert C.table_profile(negative).first()["sum"] == str(-6 * 2**62 - 15)


def test_double_sums_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).select((F.col("id") * 0.1).alias("v"))
    sums = {C.table_profile(df.repartition(n)).first()["sum"] for n in (1, 3, 7)}
    assert sums == {"1249750.000000"}


def test_declared_nullability_does_not_matter(spark):
    fixed = spark.range(3)
    loose = spark.createDataFrame([(0,), (1,), (2,)], "id bigint")
    assert verdict(fixed, loose)["matched"]


def test_empty_tables_and_no_common_columns(spark):
    empty = spark.createDataFrame([], "a int, b double")
    assert verdict(empty, empty)["matched"]
    assert checks(empty, spark.createDataFrame([], "c int")) == [("schema", None)]


def test_rounding_before_hashing(spark):
    left, right = spark.createDataFrame([(0.1 + 0.2,)], "v double"), spark.createDataFrame([(0.3,)], "v double")
    assert C.multiset_diff(left, right).count() == 2
    assert C.multiset_diff(left, right, round_floats=6).count() == 0


def test_wide_sums_use_the_tolerance(spark):
    left = spark.createDataFrame([(1e18,), (3e18,)], "v double")
    right = spark.createDataFrame([(1e18,), (3e18 * (1 + 1e-12),)], "v double")
    assert ("sum", "v") not in checks(left, right)
    assert ("sum", "v") in checks(left, right, rtol=1e-15)


def test_wide_tables_keep_generated_code(spark):
    wide = spark.range(50).select(*[(F.col("id") * k + 0.5).alias(f"c{k:03}") for k in range(200)])
    row = C.profile_row(wide).first()
    assert [c["name"] for c in row["columns"]] == [f"c{k:03}" for k in range(200)]
    assert [c["sum"] for c in row["columns"][:3]] == ["25.000000", "1250.000000", "2475.000000"]
    assert row["rows"] == 50 and row["fingerprint"] == C.fingerprint(wide).first()["fingerprint"]
    assert C.compare_tables(wide, wide.repartition(3)).first()["matched"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        plan = C.table_profile(wide)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    profiles = [line for line in plan.splitlines() if "HashAggregate" in line and "partial_count_if" in line or "partial_sum" in line]
    assert len(profiles) > 10 and all("*(" in line for line in profiles)


def test_row_diff_by_group_equals_plain_diff(spark):
    left = spark.range(500).select((F.col("id") % 7).alias("g"), (F.col("id") % 11).alias("v"))
    right = left.filter("NOT (g = 3 AND v = 5)").unionByName(spark.createDataFrame([(None, 1)], "g bigint, v bigint"))
    plain = sorted(map(str, C.row_diff(left, right).collect()))
    assert plain == sorted(map(str, C.row_diff(left, right, ["g"]).collect())) and plain


ROWS = st.lists(
    st.tuples(
        st.integers(-(2**31), 2**31 - 1) | st.none(),
        st.text(max_size=4) | st.none(),
        st.floats(width=32) | st.none(),
    ),
    min_size=1,
    max_size=12,
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS, seed=st.randoms())
def test_fingerprint_is_a_multiset_digest(spark, rows, seed):
    schema = "a int, b string, c float"
    digest = lambda data, n=2: C.fingerprint(
        spark.createDataFrame(data, schema).repartition(n).select("c", "a", "b")
    ).first()["fingerprint"]
    shuffled = list(rows)
    seed.shuffle(shuffled)
    mine = digest(rows)
    assert mine == digest(shuffled, 3)
    assert mine != digest(rows + [rows[0]])
    if len(rows) > 1:
        assert mine != digest(rows[1:])
    changed = (rows[0][0], (rows[0][1] or "") + "!", rows[0][2])
    assert mine != digest([changed] + rows[1:])


def test_gate(spark):
    report = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    passed = lambda df, kind="compare": C.gate(df, "status", kind).first()["passed"]
    assert passed(report("PASS", "PASS")) and not passed(report("PASS", "BLOCKED"))
    assert passed(report("PASS", "BLOCKED"), "certification") and not passed(report("FAIL"), "certification")
    valid = spark.createDataFrame([(True,), (False,)], "valid boolean")
    assert not C.gate(valid, "valid", "validation").first()["passed"]
