"""Comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import compare as C
from concord.operators import ledger as L
from concord.operators import reports as R
from concord.plans.registry import cents, query, table
from concord.session import scratch
from concord.sources import datasets as S

_LINEITEM = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


def _profile_sql(source: str, types: dict[str, str]) -> str:
    rows = []
    for name, kind in types.items():
        numeric = kind in ("bigint", "int", "double")
        exact = "DECIMAL(38,6)" if kind == "double" else "DECIMAL(38,0)"
        total = f"CAST(sum(CAST({name} AS {exact})) AS VARCHAR)" if numeric else "NULL"
        low, high = (f"CAST({f}({name}) AS VARCHAR)" if numeric else "NULL" for f in ("min", "max"))
        rows.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS \"type\", count(*) AS \"rows\", "
            f"count(*) - count({name}) AS nulls, {total} AS \"sum\", {low} AS \"min\", {high} AS \"max\", "
            f"CAST(0 AS BIGINT) AS wide_rows FROM {source}"
        )
    return " UNION ALL ".join(rows)


@query(_profile_sql("lineitem", _LINEITEM))
def table_profile(spark, d):
    return C.table_profile(table(spark, d, "lineitem"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year FROM lineitem")
def partition_coverage(spark, d):
    lines = table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("bigint"))
    return C.partition_coverage(lines, ["l_returnflag", "l_linestatus", "ship_year"])


_HALVES = "timestamp '1998-07-01'"


@query(
    f"""WITH l AS (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem WHERE l_shipdate < {_HALVES}),
    r AS (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem WHERE l_shipdate >= {_HALVES})
    SELECT *, 'left' AS present_in FROM (SELECT * FROM l EXCEPT SELECT * FROM r)
    UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)"""
)
def coverage_diff(spark, d):
    lines = table(spark, d, "lineitem")
    return C.coverage_diff(
        lines.filter("l_shipdate < timestamp_ntz '1998-07-01'"),
        lines.filter("l_shipdate >= timestamp_ntz '1998-07-01'"),
        ["l_suppkey", "l_quantity"],
    )


def _json_sql(types: dict[str, str]) -> str:
    """The canonical row text of lineitem in DuckDB."""
    parts = []
    for name in sorted(types):
        kind = types[name]
        value = f"'\"' || {name} || '\"'" if kind == "string" else f"CAST({name} AS VARCHAR)"
        if kind == "timestamp_ntz":
            # seconds only: the test dates carry no fraction
            value = f"'\"' || strftime({name}, '%Y-%m-%d %H:%M:%S') || '\"'"
        parts.append(f"'\"{name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_SHA = f"sha256({_json_sql(_LINEITEM)})"


@query(f"SELECT {_SHA} AS row_hash, count(*) AS n FROM lineitem GROUP BY 1")
def row_hash_counts(spark, d):
    return C.row_hash_counts(table(spark, d, "lineitem"))


def _damaged(lines):
    """Lines returned in 2001 lose their discount; lines before mid 1995 are gone."""
    changed = F.expr("l_returnflag = 'R' AND l_shipdate >= timestamp_ntz '2001-01-01'")
    return lines.filter("l_shipdate >= timestamp_ntz '1995-07-01'").withColumn(
        "l_discount", F.when(changed, F.lit(0.0)).otherwise(F.col("l_discount"))
    )


_DAMAGED = """(SELECT * REPLACE (CASE WHEN l_returnflag = 'R' AND l_shipdate >= timestamp '2001-01-01' THEN 0.0
    ELSE l_discount END AS l_discount) FROM lineitem WHERE l_shipdate >= timestamp '1995-07-01')"""


@query(
    f"""WITH h AS (SELECT {_SHA} AS row_hash, 1 AS l, 0 AS r FROM lineitem
    UNION ALL SELECT {_SHA}, 0, 1 FROM {_DAMAGED})
    SELECT row_hash, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(r) AS BIGINT) AS right_n
    FROM h GROUP BY 1 HAVING sum(l) <> sum(r)"""
)
def multiset_diff(spark, d):
    lines = table(spark, d, "lineitem")
    return C.multiset_diff(lines, _damaged(lines), digest="sha256")


@query(
    f"""WITH x AS (SELECT *, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT *, 0, 1 FROM {_DAMAGED}),
    g AS (SELECT * EXCLUDE (l, r), sum(l) AS l, sum(r) AS r FROM x GROUP BY ALL HAVING sum(l) <> sum(r))
    SELECT CAST(l AS BIGINT) AS left_n, CAST(r AS BIGINT) AS right_n, count(*) AS distinct_rows FROM g GROUP BY 1, 2"""
)
def multiset_diff_counts(spark, d):
    """The same difference on the cheap row hash, summed up by how often the rows occur."""
    lines = table(spark, d, "lineitem")
    diff = C.multiset_diff(lines, _damaged(lines))
    return diff.groupBy("left_n", "right_n").agg(F.count(F.lit(1)).alias("distinct_rows"))


_ROW = ", ".join(sorted(_LINEITEM))
_SHOWN = {"l_shipdate": "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate"}
_ROW_DIFF = f"""WITH b AS (SELECT {_ROW}, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT {_ROW}, 0, 1 FROM {_DAMAGED}),
    g AS (SELECT {_ROW}, sum(l) - sum(r) AS n FROM b GROUP BY ALL HAVING sum(l) <> sum(r))
    SELECT CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(n) AS BIGINT) AS copies,
    {", ".join(_SHOWN.get(c, c) for c in sorted(_LINEITEM))} FROM g"""


def _row_diff(spark, d, by):
    """Whole rows of lineitem, all columns."""
    lines = table(spark, d, "lineitem")
    diff = C.row_diff(lines, _damaged(lines), by)
    return diff.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query(_ROW_DIFF)
def row_diff(spark, d):
    return _row_diff(spark, d, ())


@query(_ROW_DIFF)
def row_diff_by_partition(spark, d):
    """Only ship dates whose fingerprints differ are diffed row by row."""
    return _row_diff(spark, d, ["l_shipdate"])


_DAY, _OTHER_DAY = "1998-03-01", "1999-08-20"
_SLIGHT = f"""(SELECT * REPLACE (CASE WHEN l_shipdate = timestamp '{_OTHER_DAY}' THEN l_tax + 1 ELSE l_tax END AS l_tax)
    FROM lineitem WHERE l_shipdate <> timestamp '{_DAY}')"""


@query(_ROW_DIFF.replace(_DAMAGED, _SLIGHT))
def row_diff_slight(spark, d):
    """A day is lost and a day is changed: few enough rows for the sketch to name them."""
    lines = table(spark, d, "lineitem")
    changed = F.col("l_shipdate") == F.lit(_OTHER_DAY).cast("timestamp_ntz")
    other = lines.filter(f"l_shipdate <> timestamp_ntz '{_DAY}'").withColumn(
        "l_tax", F.col("l_tax") + F.when(changed, 1.0).otherwise(0.0)
    )
    return C.row_diff(lines, other).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


# -- whole comparisons ------------------------------------------------------------------------------------


def _altered(orders):
    """Orders before February 1995 are lost and urgent orders of July 2001 on cost one more."""
    changed = F.expr("o_orderpriority = '1-URGENT' AND o_orderdate >= timestamp_ntz '2001-07-01'")
    return orders.filter("o_orderdate >= timestamp_ntz '1995-02-01'").withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(changed, 1.0).otherwise(0.0)
    )


_ALTERED = """(SELECT * REPLACE (o_totalprice + CASE WHEN o_orderpriority = '1-URGENT'
    AND o_orderdate >= timestamp '2001-07-01' THEN 1.0 ELSE 0.0 END AS o_totalprice)
    FROM orders WHERE o_orderdate >= timestamp '1995-02-01')"""


def _detail_sql(left: str, right: str) -> str:
    """Mismatches of two versions of orders in reporting order."""
    numeric = {"o_custkey": "DECIMAL(38,0)", "o_orderkey": "DECIMAL(38,0)", "o_totalprice": "DECIMAL(38,6)"}
    columns = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    aggregates = ["count(*) AS n"]
    aggregates += [f"count(*) - count({c}) AS nulls_{c}" for c in columns]
    for c, kind in numeric.items():
        aggregates.append(f"CAST(sum(CAST({c} AS {kind})) AS VARCHAR) AS sum_{c}")
        aggregates += [f"CAST({f}({c}) AS VARCHAR) AS {f}_{c}" for f in ("min", "max")]
    checks = [(2, "row_count", "NULL", "n")]
    checks += [(3, "null_count", f"'{c}'", f"nulls_{c}") for c in columns]
    checks += [(4, f, f"'{c}'", f"{f}_{c}") for c in numeric for f in ("sum", "min", "max")]
    rows = [
        f"SELECT {o} AS ord, '{k}' AS \"check\", {c} AS \"column\", CAST(l.{v} AS VARCHAR) AS \"left\", "
        f"CAST(r.{v} AS VARCHAR) AS \"right\" FROM l, r WHERE l.{v} IS DISTINCT FROM r.{v}"
        for o, k, c, v in checks
    ]
    select = ", ".join(aggregates)
    same = f"SELECT count(*) FROM (SELECT * FROM {{}} EXCEPT ALL SELECT * FROM {{}})"
    rows.append(
        "SELECT 6, 'row_content', NULL, NULL, NULL WHERE "
        f"({same.format(left, right)}) + ({same.format(right, left)}) > 0"
    )
    return f"WITH l AS (SELECT {select} FROM {left}), r AS (SELECT {select} FROM {right}) " + " UNION ALL ".join(rows)


def _without_digests(detail):
    shown = lambda c: F.when(F.col("check") != "row_content", F.col(c)).alias(c)
    return detail.select("ord", "check", "column", shown("left"), shown("right"))


@query(_detail_sql("orders", _ALTERED))
def compare_tables(spark, d):
    orders = table(spark, d, "orders")
    return _without_digests(C.compare_detail(orders, _altered(orders)))


@query("SELECT true AS matched, CAST(0 AS BIGINT) AS mismatches, count(*) AS \"rows\" FROM orders")
def compare_semantic(spark, d):
    orders = table(spark, d, "orders")
    location = scratch(spark, "copy")
    S.sink(orders.select(*reversed(orders.columns)).repartition(7, "o_custkey"), "path", location)
    verdict = R.compare_semantic(spark, f"{d}/orders.parquet", location, partition_columns=["o_orderstatus"])
    rows = S.scan(spark, "path", location).agg(F.count(F.lit(1)).alias("rows"))
    # one row on either side
    return (
        verdict.select(F.lit(1).alias("k"), "matched", F.size("mismatches").cast("bigint").alias("mismatches"))
        .unionByName(rows.withColumn("k", F.lit(1)), allowMissingColumns=True)
        .groupBy("k")
        .agg(F.max("matched").alias("matched"), F.max("mismatches").alias("mismatches"), F.max("rows").alias("rows"))
        .drop("k")
    )


_CUT = "1998-01-01"


@query(
    _detail_sql(
        f"(SELECT * FROM orders WHERE o_orderdate < timestamp '{_CUT}')",
        "orders",
    )
)
def snapshot_compare(spark, d):
    """The second version appends to the first one; only what it has added is read for it."""
    orders, location = table(spark, d, "orders"), scratch(spark, "versions")
    S.sink(orders.filter(f"o_orderdate < timestamp_ntz '{_CUT}'"), "path", location)
    before = L.ledger(spark, location)
    S.sink(orders.filter(f"o_orderdate >= timestamp_ntz '{_CUT}' OR o_orderdate IS NULL"), "path", location, "append")
    return _without_digests(L.snapshot_compare(before, L.ledger(spark, location, before)))


@query(
    """SELECT o_orderpriority, count(*) AS "rows", true AS same_in_copy,
    bool_or(o_orderdate < timestamp '1995-02-01'
        OR (o_orderpriority = '1-URGENT' AND o_orderdate >= timestamp '2001-07-01')) AS differs_altered
    FROM orders GROUP BY 1"""
)
def fingerprint(spark, d):
    orders = table(spark, d, "orders")
    by = ["o_orderpriority"]
    mine = C.fingerprint(orders, by)
    copy = C.fingerprint(orders.select(*reversed(orders.columns)).repartition(5), by)
    altered = C.fingerprint(_altered(orders), by)
    named = lambda df, name: df.select(*by, F.col("fingerprint").alias(name))
    return (
        mine.join(named(copy, "copy"), by)
        .join(named(altered, "altered"), by, "left")
        .select(
            *by,
            "rows",
            (F.col("fingerprint") == F.col("copy")).alias("same_in_copy"),
            (~F.col("fingerprint").eqNullSafe(F.col("altered"))).alias("differs_altered"),
        )
    )


@query(
    f"""WITH x AS (SELECT *, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT *, 0, 1 FROM {_DAMAGED}),
    g AS (SELECT * EXCLUDE (l, r), sum(l) AS l, sum(r) AS r FROM x GROUP BY ALL)
    SELECT l_suppkey, year(l_shipdate) AS ship_year, CAST(sum(l) AS BIGINT) AS left_rows,
    CAST(sum(r) AS BIGINT) AS right_rows FROM g GROUP BY 1, 2 HAVING bool_or(l <> r)"""
)
def partition_level_compare(spark, d):
    lines = table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("bigint"))
    return C.partition_level_compare(lines, _damaged(lines), ["l_suppkey", "ship_year"])


_INVARIANTS = {
    "positive quantity": "l_quantity > 0",
    "small discount": "l_discount <= 0.09",
    "open lines are not returned": "NOT (l_linestatus = 'O' AND l_returnflag = 'R')",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS invariant, count(*) FILTER (WHERE NOT ({rule})) AS violations, "
        f"count(*) FILTER (WHERE ({rule}) IS NULL) AS unknown FROM lineitem"
        for name, rule in _INVARIANTS.items()
    )
)
def invariants(spark, d):
    return C.invariants(table(spark, d, "lineitem"), {n: F.expr(r) for n, r in _INVARIANTS.items()})


_NET = "l_extendedprice * (1 - l_discount)"


@query(
    f"""SELECT 'net below gross' AS invariant, count(*) FILTER (WHERE NOT ({_NET} <= l_extendedprice)) AS violations,
        count(*) FILTER (WHERE {_NET} IS NULL) AS unknown
    FROM lineitem UNION ALL
    SELECT 'net above 1000', count(*) FILTER (WHERE NOT ({_NET} > 1000)), count(*) FILTER (WHERE {_NET} IS NULL) FROM lineitem"""
)
def user_transform_invariants(spark, d):
    def with_net(df):
        return df.withColumn("net", F.expr(_NET))

    return C.invariants(
        table(spark, d, "lineitem").transform(with_net),
        {"net below gross": F.expr("net <= l_extendedprice"), "net above 1000": F.expr("net > 1000")},
    )


@query(
    """WITH p AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice <= 1000) AS bad,
        count(*) FILTER (WHERE o_totalprice <= 5000) AS low FROM orders GROUP BY 1)
    SELECT 'compare' AS kind, bool_and(bad = 0) AS passed FROM p
    UNION ALL SELECT 'certification', bool_and(low = 0) FROM p
    UNION ALL SELECT 'validation', bool_and(low >= 0) FROM p"""
)
def gate(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_totalprice") <= 1000).alias("bad"), F.count_if(F.col("o_totalprice") <= 5000).alias("low")
    )
    compared = C.gate(counts, F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"))
    certified = C.gate(counts, F.when(F.col("low") == 0, "BLOCKED").otherwise("FAIL"), "certification")
    valid = C.gate(counts, F.col("low") >= 0, "validation")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "passed")
    return named(compared, "compare").unionByName(named(certified, "certification")).unionByName(named(valid, "validation"))


# -- schemas ----------------------------------------------------------------------------------------------

_CUSTOMER = {"custkey": "bigint", "name": "string", "nationkey": "int", "acctbal": "double", "mktsegment": "string"}
_SUPPLIER = {"suppkey": "bigint", "name": "string", "nationkey": "int", "acctbal": "double"}


def _unprefixed(df):
    return df.toDF(*[c.split("_", 1)[1] for c in df.columns])


def _values(column: str, source: str, prefix: str, types: dict[str, str]) -> str:
    if column not in types:
        return "CAST(NULL AS BIGINT)"
    return f"(SELECT count({prefix}_{column}) FROM {source})"


def _schema_sql() -> str:
    rows = []
    for c in sorted(_CUSTOMER | _SUPPLIER):
        l, r = _CUSTOMER.get(c), _SUPPLIER.get(c)
        text = lambda t: f"'{t}'" if t else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT '{c}' AS \"column\", {text(l)} AS left_type, {text(r)} AS right_type, {str(l == r).lower()} AS same, "
            f"{_values(c, 'customer', 'c', _CUSTOMER)} AS left_values, {_values(c, 'supplier', 's', _SUPPLIER)} AS right_values"
        )
    return " UNION ALL ".join(rows)


@query(_schema_sql())
def schema_diff(spark, d):
    left, right = _unprefixed(table(spark, d, "customer")), _unprefixed(table(spark, d, "supplier"))
    values = lambda df, name: C.table_profile(df).select("column", (F.col("rows") - F.col("nulls")).alias(name))
    return (
        C.schema_diff(left, right)
        .join(values(left, "left_values"), "column", "left")
        .join(values(right, "right_values"), "column", "left")
    )


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS shared_values FROM (SELECT c_{c} FROM customer INTERSECT SELECT s_{c} FROM supplier)"
        for c in sorted(set(_CUSTOMER) & set(_SUPPLIER))
    )
)
def common_columns(spark, d):
    left, right = _unprefixed(table(spark, d, "customer")), _unprefixed(table(spark, d, "supplier"))
    parts = [
        left.select(c).intersect(right.select(c)).agg(F.count(F.lit(1)).alias("shared_values")).select(
            F.lit(c).alias("column"), "shared_values"
        )
        for c in C.common_columns(left, right)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- runs compared with each other ------------------------------------------------------------------------

_STATUSES = ["F", "O", "P"]


@query(
    """WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    SELECT l.o_orderstatus AS left_run, r.o_orderstatus AS right_run, l.n AS left_rows, r.n AS right_rows
    FROM s l JOIN s r ON l.o_orderstatus < r.o_orderstatus"""
)
def run_pairs(spark, d):
    runs = spark.createDataFrame(list(enumerate(_STATUSES)), "position int, run string")
    counted = runs.join(
        table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("run")).agg(F.count(F.lit(1)).alias("n")), "run"
    )
    side = lambda s: counted.select(
        F.col("position").alias(f"{s}_position"), F.col("run").alias(f"{s}_run"), F.col("n").alias(f"{s}_rows")
    )
    pairs = R.run_pairs(spark, _STATUSES)
    return (
        pairs.join(side("left"), "left_position")
        .join(side("right"), "right_position")
        .select("left_run", "right_run", "left_rows", "right_rows")
    )


def _monthly(orders):
    return orders.groupBy(
        "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("cents"))


_ENVIRONMENTS = ["env-a", "env-b", "env-c", "env-d"]


def _written_runs(spark, d):
    """Four runs of one job: the same output twice, one that lost 1995, one that did not succeed."""
    orders = table(spark, d, "orders")
    root = scratch(spark, "runs")
    outputs = {
        "env-a": _monthly(orders),
        "env-b": _monthly(orders.repartition(6, "o_custkey")).select("cents", "orders", "month", "o_orderpriority"),
        "env-c": _monthly(orders.filter("o_orderdate >= timestamp_ntz '1996-01-01'")),
    }
    for env, df in outputs.items():
        S.sink(df, "path", f"{root}/{env}")
    runs = spark.createDataFrame(
        [(f"run-{e}", "monthly", "1", e, "FAILED" if e == "env-d" else "SUCCEEDED") for e in _ENVIRONMENTS],
        "id string, workload_name string, workload_version string, environment_name string, state string",
    )
    outputs_type = "struct<outputs:array<struct<name:string,dataset:string>>>"
    definitions = spark.createDataFrame(
        [("monthly", "1", ([("report", "orders.monthly")],))], f"name string, version string, definition {outputs_type}"
    )
    bindings = spark.createDataFrame(
        [("orders.monthly", e, "path", f"{root}/{e}") for e in outputs],
        "dataset_name string, environment_name string, kind string, uri string",
    )
    return runs, definitions, bindings


_RUN_IDS = [f"run-{e}" for e in _ENVIRONMENTS]


def _monthly_sql(where: str) -> str:
    return f"""(SELECT count(*) AS n, CAST(sum(c) AS BIGINT) AS cs, min(c) AS cl, max(c) AS ch, CAST(sum(o) AS BIGINT) AS os,
        min(o) AS ol, max(o) AS oh FROM (SELECT count(*) AS o, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c
        FROM orders {where} GROUP BY o_orderpriority, strftime(o_orderdate, '%Y-%m')))"""


_CHECKS = {"n": "row count"} | {
    f"{metric[0]}{code}": f"{check}('{metric}')"
    for metric in ("cents", "orders")
    for check, code in (("sum", "s"), ("min", "l"), ("max", "h"))
}
# the whole list for the run that lost 1995, in report order
_DIFFERENCES = ", ".join(
    "CASE WHEN a.{0} <> b.{0} THEN '{1} mismatch: left=' || a.{0} || ' right=' || b.{0} END".format(c, label.replace("'", "''"))
    for c, label in _CHECKS.items()
)
_LOST = f"""(SELECT concat_ws('; ', {_DIFFERENCES}, 'row content mismatch: deterministic row hashes differ')
    FROM {_monthly_sql("")} a, {_monthly_sql("WHERE o_orderdate >= timestamp '1996-01-01'")} b)"""
_NOT_DONE = "'run not SUCCEEDED (state=FAILED)'"


@query(
    f"""SELECT 'env-a' AS left_environment, 'env-b' AS right_environment, 'PASS' AS status, '' AS mismatches
    UNION ALL SELECT 'env-a', 'env-c', 'FAIL', {_LOST}
    UNION ALL SELECT 'env-a', 'env-d', 'BLOCKED', {_NOT_DONE}
    UNION ALL SELECT 'env-b', 'env-c', 'FAIL', {_LOST}
    UNION ALL SELECT 'env-b', 'env-d', 'BLOCKED', {_NOT_DONE}
    UNION ALL SELECT 'env-c', 'env-d', 'BLOCKED', {_NOT_DONE}"""
)
def conformance_report(spark, d):
    report = R.conformance_report(spark, _RUN_IDS, *_written_runs(spark, d), "report")
    return report.select(
        "left_environment", "right_environment", "status", F.array_join("mismatches", "; ").alias("mismatches")
    )


@query(
    """SELECT 'env-a' AS environment_name, 'env-a' AS class, CAST(2 AS BIGINT) AS members
    UNION ALL SELECT 'env-b', 'env-a', 2 UNION ALL SELECT 'env-c', 'env-c', 1"""
)
def equivalence_classes(spark, d):
    requested = spark.createDataFrame(list(enumerate(_RUN_IDS)), "position int, run_id string")
    legs = R.resolve_legs(requested, *_written_runs(spark, d))
    profiles = R.profile_locations(
        spark, legs, lambda kind, uri: S.scan(spark, kind, uri), lambda uris, schema: spark.read.schema(schema).parquet(*uris)
    )
    named = legs.join(profiles, ["kind", "uri"])
    return R.equivalence_classes(named, ["environment_name"]).select(
        "environment_name", F.col("class.environment_name").alias("class"), "members"
    )


@query(
    """WITH m AS (SELECT o_orderpriority, year(o_orderdate) AS y, CAST(count(*) AS DOUBLE) AS orders,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cents FROM orders GROUP BY 1, 2),
    j AS (SELECT l.o_orderpriority, l.orders AS lo, r.orders AS ro, l.cents AS lc, r.cents AS rc
        FROM m l JOIN m r ON l.o_orderpriority = r.o_orderpriority AND l.y = 1996 AND r.y = 1997)
    SELECT o_orderpriority, 'orders' AS metric, lo AS "left", ro AS "right", ro - lo AS difference, ro / lo AS ratio FROM j
    UNION ALL SELECT o_orderpriority, 'cents', lc, rc, rc - lc, rc / lc FROM j"""
)
def performance_delta(spark, d):
    orders = table(spark, d, "orders")
    metrics = lambda year: orders.filter(F.year("o_orderdate") == year).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("cents")
    )
    return R.performance_delta(metrics(1996), metrics(1997), ["o_orderpriority"], ["orders", "cents"])
