"""Ledgers of profiles per file, shared scans and classes of runs."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from concord.operators import compare as C
from concord.operators import ledger as L
from concord.operators import reports as R


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "a b%c[1]{x}")


@pytest.fixture
def reads(monkeypatch):
    """The paths of files that were read, a list for each scan."""
    seen, real = [], L._read

    def read(spark, schema, paths, format):
        seen.append(paths)
        return real(spark, schema, paths, format)

    monkeypatch.setattr(L, "_read", read)
    return seen


def put(place, name, rows, **types):
    os.makedirs(os.path.dirname(f"{place}/{name}"), exist_ok=True)
    columns = {"k": pa.array([r[0] for r in rows], types.get("k", pa.int64())), "v": pa.array([r[1] for r in rows], pa.float64())}
    pq.write_table(pa.table(columns), f"{place}/{name}")


def escaped(place):
    return L._escaped(place)


def profile(df):
    return df.select("rows", "columns", "fingerprint").first()


def test_profile_is_that_of_the_data(spark, sf_dir):
    for name in ("orders", "lineitem", "events", "part"):
        path = f"{sf_dir}/{name}.parquet"
        assert profile(L.ledger(spark, path).profile()) == profile(C.profile_row(spark.read.parquet(path)))


def test_only_changed_files_are_read(spark, place, reads):
    here = escaped(place)
    for k in range(4):
        put(place, f"part-{k}.parquet", [(k, 0.5), (None, -0.0), (k * 10, float("nan"))])
    put(place, "part-empty.parquet", [])
    one = L.ledger(spark, here)
    assert len(reads.pop()) == 5
    again = L.ledger(spark, here, one)
    assert reads == [] and L.snapshot_compare(one, again).collect() == [] and L.changed_files(one, again).collect() == []

    put(place, "part-9.parquet", [(7, 1.0)])
    os.remove(f"{place}/part-1.parquet")
    put(place, "part-2.parquet", [(2, 0.5), (None, 0.0), (21, float("nan"))])  # the same size under the old name
    os.utime(f"{place}/part-2.parquet", (2_000_000_000, 2_000_000_000))
    two = L.ledger(spark, here, one)
    assert sorted(os.path.basename(p) for p in reads.pop()) == ["part-2.parquet", "part-9.parquet"]
    now = spark.read.parquet(here)
    assert str(profile(two.profile())) == str(profile(C.profile_row(now)))  # NaN is not itself
    changes = {(os.path.basename(r["file"]), r["change"]) for r in L.changed_files(one, two).collect()}
    assert changes == {("part-9.parquet", "added"), ("part-1.parquet", "removed"), ("part-2.parquet", "rewritten")}
    found = [(r["check"], r["column"], r["left"], r["right"]) for r in L.snapshot_compare(one, two).orderBy("ord").collect()]
    assert ("row_count", None, "12", "10") in found and ("max", "k", "30", "30") not in found


def test_a_ledger_is_kept(spark, place, tmp_path, reads):
    put(place, "x.parquet", [(1, 1.0)])
    L.ledger(spark, escaped(place), path=str(tmp_path / "book"))
    put(place, "y.parquet", [(2, 2.0)])
    book = L.ledger(spark, escaped(place), L.load(spark, str(tmp_path / "book")))
    assert len(reads[1]) == 1 and profile(book.profile())["rows"] == 2


def test_another_schema_reads_all_again(spark, place, reads):
    put(place, "x.parquet", [(1, 1.0)])
    one = L.ledger(spark, escaped(place))
    put(place, "x.parquet", [(1, 1.0)], k=pa.int32())
    two = L.ledger(spark, escaped(place), one)
    assert len(reads) == 2
    assert [r["check"] for r in L.snapshot_compare(one, two).collect()] == ["schema"]


def test_folders_with_partition_columns(spark, place, reads):
    put(place, "d=1/x.parquet", [(1, 1.0)])
    one = L.ledger(spark, escaped(place))
    put(place, "d=2/x.parquet", [(1, 1.0)])
    two = L.ledger(spark, escaped(place), one)
    assert len(reads[1]) == 1
    assert profile(two.profile()) == profile(C.profile_row(spark.read.parquet(escaped(place))))


def legs_of(spark, uris):
    rows = [(k, f"run{k}", f"env{k}", "path", u, None) for k, u in enumerate(uris)]
    return spark.createDataFrame(rows, "position int, run_id string, environment_name string, kind string, uri string, reason string")


def test_three_hundred_locations_are_three_scans(spark, tmp_path):
    uris = []
    for k in range(300):
        uris.append(str(tmp_path / f"out-{k}"))
        types = {"k": (pa.int64(), pa.int32(), pa.int16())[k % 3]}
        put(uris[-1], "a.parquet", [(k % 7, 0.5)], **types)
        if k % 2:
            put(uris[-1], "b.parquet", [(None, 1.5)], **types)
    scans = []

    def together(paths, schema):
        scans.append(paths)
        return spark.read.schema(schema).parquet(*paths)

    legs = legs_of(spark, uris)
    profiles = R.profile_locations(spark, legs, lambda kind, uri: spark.read.parquet(uri), together)
    assert len(scans) == 3 and sum(map(len, scans)) == 300
    rows = {r["uri"]: r["p"] for r in profiles.collect()}
    assert len(rows) == 300
    for k in (0, 1, 2, 155, 299):
        assert rows[uris[k]] == profile(C.profile_row(spark.read.parquet(uris[k])))


def test_locations_inside_one_another(spark, tmp_path):
    outer, inner, parted, empty = (str(tmp_path / n) for n in ("outer", "outer/inner", "parted", "empty"))
    put(inner, "a.parquet", [(1, 1.0), (2, 2.0)])
    put(outer, "b.parquet", [(3, 3.0)])
    put(parted, "d=1/c.parquet", [(4, 4.0)])
    put(empty, "d.parquet", [])
    read = lambda uri: spark.read.option("recursiveFileLookup", uri in (outer, inner)).parquet(uri)
    legs = legs_of(spark, [outer, inner, parted, empty])
    together = lambda paths, schema: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
    profiles = R.profile_locations(spark, legs, lambda kind, uri: read(uri), together)
    rows = {r["uri"]: r["p"] for r in profiles.collect()}
    for uri in (outer, inner, parted, empty):
        assert rows[uri] == profile(C.profile_row(read(uri))), uri
    assert (rows[outer]["rows"], rows[inner]["rows"], rows[empty]["rows"]) == (3, 2, 0)


def test_two_thousand_runs_in_five_classes(spark, tmp_path):
    for k in range(5):
        put(str(tmp_path / f"out-{k}"), "a.parquet", [(n, 0.5 * k) for n in range(3)])
    runs = spark.range(2_000).selectExpr(
        "CAST(id AS STRING) AS id", "'w' AS workload_name", "'1' AS workload_version", "concat('env', id % 5) AS environment_name",
        "if(id % 100 = 99, 'FAILED', 'SUCCEEDED') AS state",
    )
    outputs = "name string, version string, definition struct<outputs:array<struct<name:string,dataset:string>>>"
    definitions = spark.createDataFrame([("w", "1", ([("o", "out")],))], outputs)
    bound = [("out", f"env{k}", "path", str(tmp_path / f"out-{k}")) for k in range(5)]
    bindings = spark.createDataFrame(bound, "dataset_name string, environment_name string, kind string, uri string")
    ids = [str(k) for k in range(2_000)]
    found = R.conformance_classes(spark, ids, runs, definitions, bindings)
    classes = {r["position"]: r["class"] for r in found.runs.collect()}
    assert classes == {k: None if k % 100 == 99 else k % 5 for k in range(2_000)}
    differences = {(r["left_class"], r["right_class"]): r["mismatches"] for r in found.differences.collect()}
    assert sorted(differences) == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    assert differences[1, 3][0].startswith("sum('v') mismatch")
    pairs = [(0, 5), (7, 1), (99, 0), (1_003, 1)]
    named = {r["pair"]: r for r in R.conformance_report(spark, ids, runs, definitions, bindings, pairs=pairs).collect()}
    assert [named[k]["status"] for k in range(4)] == ["PASS", "FAIL", "BLOCKED", "FAIL"]
    assert named[3]["mismatches"] == differences[1, 3]
