import pytest
from pyspark.errors import PySparkException

from concord.operators import jobs as J
from concord import jobs as runnable
from concord import session
from concord.session import scratch
from concord.sources import datasets as S

CLAIMS = "claim_id string, provider_id string, amount string, service_date string"
REFERENCE = "provider_id string, provider_name string, specialty string"


def claims(spark, rows=None):
    rows = rows or [("C1", "P1", "1500.00", "2026-01-05"), ("C2", "P2", "250.00", "2026-01-06"), ("C3", "P1", "50.00", "2026-01-07"), ("C4", "P9", "900.00", "2026-01-08")]
    return spark.createDataFrame(rows, CLAIMS)


def reference(spark, extra=()):
    rows = [("P1", "  dr. jane smith  ", "Cardiology"), ("P2", "dr. john doe", "Dermatology"), *extra]
    return spark.createDataFrame(rows, REFERENCE)


def test_claims(spark):
    out = J.join_and_normalize(claims(spark), reference(spark))
    assert out.columns == ["claim_id", "provider_id", "provider_name", "specialty", "amount", "service_date", "provider_matched", "amount_band"]
    rows = {r["claim_id"]: r for r in out.collect()}
    assert len(rows) == 4
    assert (rows["C1"]["provider_name"], rows["C1"]["amount_band"]) == ("DR. JANE SMITH", "high")
    assert (rows["C2"]["amount_band"], rows["C3"]["amount_band"]) == ("medium", "low")
    assert (rows["C4"]["provider_name"], rows["C4"]["provider_matched"], rows["C4"]["amount"]) == (None, False, 900.0)


def test_duplicate_reference_and_malformed_amount(spark):
    doubled = J.join_and_normalize(claims(spark), reference(spark, [("P1", None, "Surgery")]))
    assert doubled.count() == 6
    assert doubled.filter("provider_id = 'P1' AND NOT provider_matched").count() == 2
    bad = claims(spark, [("C1", "P1", "abc", "d"), ("C2", "P1", None, "d")])
    assert [r["amount_band"] for r in J.join_and_normalize(bad, reference(spark)).collect()] == ["low", "low"]
    with pytest.raises(PySparkException):
        J.join_and_normalize(bad, reference(spark), strict=True).collect()


def test_word_count(spark):
    lines = ["the quick fox the", "  The fox\tdog the", "", "The dog jumps"] * 50
    counts = J.word_count(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in counts] == [("the", 250), ("dog", 100), ("fox", 100), ("jumps", 50), ("quick", 50)]


def test_csv_is_all_text(spark):
    path = scratch(spark, "csv")
    S.sink(spark.createDataFrame([(1, "a")], "id int, label string"), "path", path, format="csv")
    back = S.scan(spark, "path", path, "csv")
    assert dict(back.dtypes) == {"id": "string", "label": "string"} and back.first()["id"] == "1"


def test_portable_config(spark):
    key = "spark.portable.dataset.wordcount.raw.uri"
    with pytest.raises(PySparkException):
        S.portable_config(spark, key, {}, [])
    assert S.portable_config(spark, key, {}, [f"--{key}=s3a://args"]) == "s3a://args"
    env = {"SPARK_PORTABLE_DATASET_WORDCOUNT_RAW_URI": "s3a://env"}
    assert S.portable_config(spark, key, env, [f"--{key}=s3a://args"]) == "s3a://env"
    spark.conf.set(key, "s3a://conf")
    try:
        assert S.portable_config(spark, key, env, []) == "s3a://conf"
    finally:
        spark.conf.unset(key)


def test_unbound_dataset_is_an_error(spark):
    bindings = spark.createDataFrame([("a", "prod", "path", "x")], "dataset_name string, environment_name string, kind string, uri string")
    with pytest.raises(LookupError, match="no binding for environment 'dev'"):
        S.read_dataset(spark, "a", "dev", bindings)
    with pytest.raises(LookupError, match="no Dataset definition found for 'b'"):
        S.read_dataset(spark, "b", "prod", bindings)


class _Conf:
    """Stands for the configuration of a cluster session."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_scratch_follows_the_session(spark):
    shared = _Conf(spark_master="yarn", spark_checkpoint_dir="hdfs://shared/place/")
    assert scratch(shared, "x").startswith("hdfs://shared/place/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(_Conf(spark_master="yarn"), "x")
    assert scratch(spark, "x") != scratch(spark, "x")


def test_jobs_end_to_end(spark):
    root = scratch(spark, "jobs")
    S.sink(claims(spark), "path", f"{root}/claims", format="csv")
    S.sink(reference(spark), "path", f"{root}/reference", format="csv")
    S.sink(spark.createDataFrame([("b a b",)], "value string"), "path", f"{root}/lines", format="text")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS job_tables LOCATION '{root}/tables'")
    places = {
        "claims.raw.uri": f"{root}/claims",
        "provider.reference.uri": f"{root}/reference",
        "claims.normalized.uri": f"{root}/normalized",
        "wordcount.raw.uri": f"{root}/lines",
        "wordcount.counts.uri": f"{root}/counts",
        "demo.table.identifier": "job_tables.demo",
        "demo.readback.uri": f"{root}/readback",
    }
    argv = [f"--spark.portable.dataset.{name}={place}" for name, place in places.items()]
    options = {"environ": {}, "argv": argv}
    runnable.normalize_claims(spark, **options)
    assert S.scan(spark, "path", f"{root}/normalized").filter("provider_matched").count() == 3
    runnable.count_words(spark, **options)
    assert {tuple(r) for r in S.scan(spark, "path", f"{root}/counts").collect()} == {("b", 2), ("a", 1)}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, label string")
    runnable.write_table(spark, rows, **options)
    with pytest.raises(PySparkException):
        runnable.write_table(spark, rows, **options)
    runnable.dump_table(spark, **options)
    assert sorted(map(tuple, S.scan(spark, "path", f"{root}/readback", "json").select("id", "label").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    spark.sql("DROP TABLE job_tables.demo")
