"""One query per operator, with its production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.llm import bpe, chat, ctph, ftrl, kdtree, lexical, mixing, patience, pieces, rules, simhash, urlfilter, variants
from concord.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary of the BPE query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_path() -> str:
    """The model of the SentencePiece query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Target weights of the mixture, by path of the tree: three domains of sources, their languages, two sources.
MIX_SHARE = 0.6
MIX_WEIGHTS = [
    (["web"], 2.0),
    (["reference"], 3.0),
    (["forum"], 1.0),
    (["web", "en"], 3.0),
    (["web", "de"], 1.0),
    (["web", "fr"], 1.0),
    (["web", "es"], 1.0),
    (["reference", "en"], 2.0),
    (["forum", "en"], 4.0),
    (["web", "en", "src0"], 1.0),
    (["reference", "en", "src5"], 3.0),
]


def domain(source: Column) -> Column:
    """The domain of a source name: src0 is the web crawl, src1 to src9 are reference works, the rest are forums."""
    return F.when(source == "src0", "web").when(F.length(source) == 4, "reference").otherwise("forum")


def mix_levels() -> list[Column]:
    return [domain(F.col("source")), F.col("lang"), F.col("source")]


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "path array<string>, weight double")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ftrl.judge(docs, ftrl.fit(docs, table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [kdtree.Text(F.col("lang")), kdtree.Text(F.col("source")), kdtree.number(F.col("n_chars"))]
    return kdtree.shard(table(spark, sf_dir, "documents"), dims)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), known)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mix_levels(), mix_weights(spark), MIX_SHARE)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), pieces_path())


#: host and path of a DuckDB ``url``, as the contract of the rules reads it.
_HOST = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
URL_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PATH} AS path FROM pages),
n AS (SELECT row_number() OVER () AS k, * FROM u),
f AS (
  SELECT n.*, r.host || r.path AS rule, r.verdict, row_number() OVER (
    PARTITION BY k ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict DESC) AS best
  FROM n LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{urlfilter.DEFAULT}') AS verdict FROM f WHERE best = 1
"""


def queries() -> dict[str, Query]:
    """Name -> query."""
    found = [
        op1_chat_rotation,
        op2_document_fingerprints,
        op3_quality_classifier,
        op4_bpe,
        op5_kdtree_sharding,
        op6_quality_rules,
        op7_url_filters,
        op8_license_scan,
        op9_simhash,
        op10_mixing,
        op11_spelling_variants,
        op12_lexical_search,
        op13_sentencepiece,
    ]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    """Name -> the same in SQL; the other operators are tested against brute force."""
    return {"op1_chat_rotation": chat.SQL, "op7_url_filters": URL_SQL, "op12_lexical_search": lexical.SQL}
