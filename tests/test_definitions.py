import json

import pytest
from pyspark.sql import functions as F

from concord.functions import definition as D
from concord.functions import state as S
from concord.functions import text as X
from concord.functions import uri as U
from concord.operators import resolve as R
from concord.operators import validate as V

pytestmark = pytest.mark.usefixtures("interpreted")

GOLDEN = {
    "apiVersion": "runtime/v1",
    "kind": "SparkWorkload",
    "metadata": {"name": "claims-normalization", "version": "4.18.2"},
    "runtime": {"spark": "4.1"},
    "application": {
        "type": "python-wheel",
        "artifact": "artifact://claims-normalization/4.18.2",
        "entryPoint": "claims.jobs.normalize",
    },
    "datasets": {
        "inputs": {"claims": {"dataset": "claims.raw"}, "reference": {"dataset": "provider.reference"}},
        "outputs": {"zeta": {"dataset": "claims.normalized"}, "alpha": {"dataset": "claims.rejected"}},
    },
    "resources": {
        "driver": {"cores": 2, "memory": "8Gi"},
        "executor": {"cores": "4", "memory": "16Gi"},
        "scaling": {"minExecutors": 10, "maxExecutors": 100},
    },
    "execution": {"timeout": "4h"},
}


def changed(**parts):
    return {**GOLDEN, **parts}


def parsed(spark, *documents):
    rows = [(i, json.dumps(d) if isinstance(d, dict) else d) for i, d in enumerate(documents)]
    return V.parse_definitions(spark.createDataFrame(rows, "i int, definition string"))


def errors(spark, *documents):
    out = V.validate_definitions(parsed(spark, *documents)).orderBy("i")
    return [list(r["errors"]) for r in out.collect()]


def test_defaults(spark):
    w = parsed(spark, GOLDEN).first()["definition"]
    assert (w["execution"]["retries"], w["resources"]["executor"]["cores"], w["arguments"]) == (0, 4, [])
    assert not any(w["requirements"]) and w["providerOverrides"] == {}
    assert [o["name"] for o in w["outputs"]] == ["zeta", "alpha"]


def test_rules(spark):
    app = GOLDEN["application"]
    got = errors(
        spark,
        GOLDEN,
        changed(apiVersion="runtime/v2"),
        changed(application={"type": "spark-declarative-pipeline"}),
        changed(application={**app, "entryPoint": ""}),
        changed(application={**app, "type": "sql"}),
        {k: v for k, v in GOLDEN.items() if k not in ("kind", "execution", "datasets")},
        "not json",
        None,
    )
    assert got[0] == []
    assert got[1] == ["apiVersion must be runtime/v1 or runtime/v1alpha1: runtime/v2"]
    assert got[2] == ["pipelineSpec is required when type is 'spark-declarative-pipeline'"]
    assert got[3] == ["artifact and entryPoint are required when type is 'python-wheel'"]
    assert got[4][0].startswith("application.type must be")
    assert got[5] == ["missing kind", "missing datasets", "missing execution.timeout"]
    assert "missing kind" in got[6] and "missing kind" in got[7]


def test_mistyped_values_are_errors(spark):
    res = GOLDEN["resources"]
    got = errors(
        spark,
        changed(execution={"timeout": "4h", "retries": "many"}, requirements={"gpu": "banana", "streaming": "ON"}),
        changed(datasets={"inputs": {"claims": {}}, "outputs": {"x": {"dataset": "d"}}}),
        changed(resources={**res, "driver": {"cores": "abc", "memory": "8Gi"}}),
        changed(resources={**res, "driver": {"cores": 2.0, "memory": "8Gi"}}, execution={"timeout": "4h", "retries": 2.5}),
        changed(requirements=None, arguments=None),
        changed(requirements={"gpu": 1, "streaming": "no", "localDisk": "off", "sparkConnect": "Yes"}),
    )
    assert got[0] == ["execution.retries must be a whole number: many", "requirements.gpu must be true or false: banana"]
    assert got[1] == ["missing datasets.inputs.claims.dataset"]
    assert got[2] == ["resources.driver.cores must be a whole number: abc"]
    assert got[3] == ["execution.retries must be a whole number: 2.5"]
    assert got[4] == ["arguments must not be null", "requirements must not be null"]
    assert got[5] == []
    flags = parsed(spark, changed(requirements={"gpu": "on", "streaming": "NO"})).first()["definition"]["requirements"]
    assert (flags["gpu"], flags["streaming"]) == (True, False)


def test_nulls_never_count_as_valid(spark):
    docs = parsed(spark, {k: v for k, v in GOLDEN.items() if k != "runtime"}).withColumn("provider", F.lit("p"))
    caps = spark.createDataFrame(
        [("p", ["4.1"], ["python"], False, False, False, True, False)],
        "provider string, spark_versions array<string>, languages array<string>, dynamic_allocation boolean, gpu boolean, "
        "streaming boolean, local_disk boolean, spark_connect boolean",
    )
    row = V.validate_workloads(docs, caps, "provider").first()
    assert (row["valid"], list(row["errors"])) == (False, ["unsupported Spark version: NULL"])
    refs = spark.createDataFrame([(None, "e"), ("d", None), ("d", "e")], "dataset string, environment_name string")
    bound = spark.createDataFrame([("d", "e", "path", "u")], "dataset_name string, environment_name string, kind string, uri string")
    found = R.resolve_datasets(refs, bound).collect()
    assert {(r["dataset"], r["environment_name"]): r["error"] for r in found} == {
        (None, "e"): "no Dataset definition found for 'NULL'",
        ("d", None): "dataset 'd' has no binding for environment 'NULL'",
        ("d", "e"): None,
    }
    places = spark.createDataFrame([("artifact://a/1", None), (None, "e")], "reference string, environment_name string")
    binding = spark.createDataFrame([("a", "1", "e", "u")], "artifact_name string, artifact_version string, environment_name string, uri string")
    found = R.resolve_artifacts(places, binding).collect()
    assert {r["error"] for r in found} == {
        "artifact 'a/1' has no binding for environment 'NULL'", "not an artifact:// reference: NULL"
    }
    uris = spark.createDataFrame([("s3", None), (None, "s3://b/c"), ("s3", "s3://b/c")], "protocol string, uri string")
    both = uris.select(U.uri_error(F.col("protocol"), F.col("uri")).alias("e"), U.comparable_uri_error(F.col("uri")).alias("c")).collect()
    assert [tuple(r) for r in both] == [
        ("not an S3 URI: NULL", "unsupported URI scheme: NULL"), ("unsupported storage protocol: NULL", None), (None, None)
    ]


def test_capabilities_name_every_gap_in_order(spark):
    caps = spark.createDataFrame(
        [("p", ["4.1"], ["jvm"], False, False, False, True, False)],
        "provider string, spark_versions array<string>, languages array<string>, dynamic_allocation boolean, gpu boolean, "
        "streaming boolean, local_disk boolean, spark_connect boolean",
    )
    doc = changed(runtime={"spark": "4.2"}, requirements={"gpu": True, "streaming": True, "localDisk": True})
    pairs = V.for_each_target(parsed(spark, doc), ["p"], "provider")
    row = V.validate_workloads(pairs, caps, "provider").first()
    assert list(row["errors"]) == [
        "unsupported Spark version: 4.2",
        "unsupported language: python",
        "workload requires GPU, provider does not support it",
        "workload requires streaming, provider does not support it",
    ]
    assert not row["valid"] and row["portability_status"] == "PORTABLE"


def test_portability(spark):
    docs = [GOLDEN, changed(providerOverrides={"kubernetes": {}}), changed(providerOverrides={"a": {}, "b": {"x": 1, "y": {"z": 2}}})]
    w = F.col("definition")["providerOverrides"]
    rows = parsed(spark, *docs).orderBy("i").select(D.portability_status(w).alias("s"), D.override_counts(w).alias("n")).collect()
    assert [r["s"] for r in rows] == ["PORTABLE", "PORTABLE", "PORTABLE_WITH_OVERRIDES"]
    assert [r["n"] for r in rows] == [{}, {"kubernetes": 0}, {"a": 0, "b": 2}]


BINDINGS = "dataset_name string, environment_name string, kind string, uri string"


def test_dataset_resolution(spark):
    refs = spark.createDataFrame([("w", "a", "prod"), ("w", "b", "prod"), ("w", "c", "prod"), ("w", "d", "prod")], "name string, dataset string, environment_name string")
    bindings = spark.createDataFrame([("a", "prod", "path", "s3a://x"), ("b", "prod", "table", "db.t"), ("c", "dev", "path", "s3a://y")], BINDINGS)
    rows = {r["dataset"]: r for r in R.resolve_datasets(refs, bindings, "cat").collect()}
    assert (rows["a"]["config_key"], rows["a"]["config_value"]) == ("spark.portable.dataset.a.uri", "s3a://x")
    assert (rows["b"]["config_key"], rows["b"]["config_value"]) == ("spark.portable.dataset.b.identifier", "cat.db.t")
    assert rows["c"]["error"] == "dataset 'c' has no binding for environment 'prod'"
    assert rows["d"]["error"] == "no Dataset definition found for 'd'"
    resolved = R.resolve_datasets(refs, bindings, "cat")
    profiles = "environment_name string, catalog_uri string, catalog_warehouse string, s3_endpoint string"
    ready = R.catalog_requirement(resolved, spark.createDataFrame([("prod", "http://c", "s3://w", None)], profiles), catalog="cat")
    keys = {r["config_key"]: r["config_value"] for r in ready.collect()}
    assert keys["spark.sql.catalog.cat.uri"] == "http://c" and len(keys) == 6
    broken = R.catalog_requirement(resolved, spark.createDataFrame([("prod", "http://c", "", None)], profiles), catalog="cat").collect()
    assert len(broken) == 1 and "catalog uri or warehouse" in broken[0]["error"]
    paths = R.catalog_requirement(resolved.filter("kind = 'path'"), spark.createDataFrame([], profiles))
    assert paths.count() == 0


def test_artifacts(spark):
    texts = ["artifact://n/1/2", "artifact://n", "artifact:///1", "local:///x.jar"]
    df = spark.createDataFrame([(t, "prod") for t in texts], "reference string, environment_name string")
    bindings = spark.createDataFrame([("n", "1/2", "prod", "s3a://n.whl")], "artifact_name string, artifact_version string, environment_name string, uri string")
    rows = {r["reference"]: (r["resolved"], r["error"]) for r in R.resolve_artifacts(df, bindings).collect()}
    assert rows["artifact://n/1/2"] == ("s3a://n.whl", None) and rows["local:///x.jar"] == ("local:///x.jar", None)
    assert rows["artifact://n"][1].startswith("malformed") and rows["artifact:///1"][1].startswith("malformed")
    parsed_one = df.limit(1).select(U.parse_artifact(F.col("reference")).alias("p")).first()["p"]
    assert (parsed_one["name"], parsed_one["version"]) == ("n", "1/2")


def test_merge(spark):
    rows = [("s", "k", 0, "base"), ("s", "k", 2, "dataset"), ("s", "k", 1, "storage"), ("s", "j", 0, "base")]
    df = spark.createDataFrame(rows, "scope string, key string, priority int, value string")
    assert sorted(map(tuple, R.merge_config(df).collect())) == [("s", "j", "base"), ("s", "k", "dataset")]
    maps = spark.createDataFrame([({"a": "1", "b": "1"}, None, {"a": "3"})], "x map<string,string>, y map<string,string>, z map<string,string>")
    assert maps.select(R.merged_maps(F.col("x"), F.col("y"), F.col("z")).alias("m")).first()["m"] == {"a": "3", "b": "1"}


def test_operator_states(spark):
    rows = [
        ("RunningHealthy", None), ("SomeUnknownFutureState", None), (None, None),
        ("ResourceReleased", {"0": "Submitted", "1": "RunningHealthy", "2": "Succeeded", "3": "ResourceReleased"}),
        ("ResourceReleased", {"9": "Succeeded", "10": "Failed"}),
        ("ResourceReleased", {"1": "Failed", "x": "Succeeded"}),
        ("ResourceReleased", None),
    ]
    df = spark.createDataFrame(rows, "state string, history map<string,string>").coalesce(1)
    got = [tuple(r["s"]) for r in df.select(S.operator_state(F.col("state"), F.col("history")).alias("s")).collect()]
    assert got == [
        ("RUNNING", "RunningHealthy"), ("UNKNOWN", "SomeUnknownFutureState"), ("SUBMITTING", "Unreported"),
        ("SUCCEEDED", "Succeeded"), ("FAILED", "Failed"), ("UNKNOWN", "ResourceReleased"), ("UNKNOWN", "ResourceReleased"),
    ]


def test_jobs_states(spark):
    rows = [("PENDING", None), ("RUNNING", "SUCCESS"), ("TERMINATED", "SUCCESS"), ("TERMINATED", "CANCELED"), ("TERMINATED", None), ("INTERNAL_ERROR", None), (None, None)]
    df = spark.createDataFrame(rows, "l string, r string").coalesce(1)
    got = [tuple(r["s"]) for r in df.select(S.jobs_state(F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [
        ("QUEUED", "PENDING"), ("RUNNING", "RUNNING"), ("SUCCEEDED", "TERMINATED/SUCCESS"), ("CANCELED", "TERMINATED/CANCELED"),
        ("UNKNOWN", "TERMINATED"), ("FAILED", "INTERNAL_ERROR"), ("UNKNOWN", "UNKNOWN"),
    ]


def test_durations(spark):
    df = spark.sql("""SELECT * FROM VALUES (0, 125.5, 1), (0, 59.4, 2), (10, 0, 3), (NULL, 5, 4), (0, NULL, 5) AS t(b, e, i)""").coalesce(1)
    ts = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("bigint"))
    shown = df.orderBy("i").select(S.format_duration(ts("b"), ts("e"), F.lit("1970-01-01 01:00:00").cast("timestamp")).alias("d"))
    assert [r["d"] for r in shown.collect()] == ["2m 6s", "59s", "0s", "—", "60m 0s"]


def test_uris_and_protocols(spark):
    df = spark.createDataFrame([("s3", "s3a://b/k"), ("s3", "gs://b"), ("vast-nfs", "/mnt/a"), ("vast-nfs", "/tmp"), ("tape", "x")], "p string, u string").coalesce(1)
    bad = [r["e"] is None for r in df.select(U.uri_error(F.col("p"), F.col("u"), mount_path=F.lit("/mnt")).alias("e")).collect()]
    assert bad == [True, False, True, False, False]
    parts = df.limit(1).select(U.split_uri(F.col("u")).alias("x")).first()["x"]
    assert tuple(parts) == ("s3a", "b", "/k")
    labels = spark.createDataFrame([("vast", '{"protocol":"nfs"}'), ("vast", "{}"), ("adls", None)], "p string, c string").coalesce(1)
    assert [r["l"] for r in labels.select(U.storage_protocol(F.col("p"), F.col("c")).alias("l")).collect()] == ["vast-nfs", "vast-s3", "adls"]


def test_runtimes(spark):
    df = spark.createDataFrame([("4.1", "x"), ("5.0", "y"), ("5.1", None)], "spark_version string, override string")
    observed = spark.createDataFrame([("18.2.x-scala2.13", "18.2 (Spark 4.1.0)")], "key string, name string")
    rows = {r["spark_version"]: (r["runtime_key"], r["drift"]) for r in V.resolve_runtimes(df, observed).collect()}
    assert rows["4.1"] == ("18.2.x-scala2.13", None) and rows["5.1"] == (None, None)
    assert rows["5.0"][0] == "y" and "was not found" in rows["5.0"][1]


def test_access(spark):
    df = spark.createDataFrame([(["ops", "none"], "Operator"), (["devs"], "Operator"), (["none"], "Viewer"), ([], "Viewer")], "groups array<string>, required_role string").coalesce(1)
    allowed = V.access_review(df, {"ops": "PlatformAdmin", "devs": "Developer"})
    assert [r["allowed"] for r in allowed.collect()] == [True, False, False, False]


def test_amounts(spark):
    df = spark.createDataFrame([("1000",), ("100",), ("99.9",), (None,), ("abc",)], "a string").coalesce(1)
    bands = [r["b"] for r in df.select(X.amount_band(X.amount(F.col("a"))).alias("b")).collect()]
    assert bands == ["high", "medium", "low", "low", "low"]
