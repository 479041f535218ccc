"""Against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.llm import bpe, queries
from concord.llm.base import table

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.definition(PATH))


def same(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == " ".join(map(str, ids))
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


TEXTS = [
    "",
    "<|endoftext|>",
    "A<|startoftext|>b<|endoftext|><|endoftext|> c",
    "<|endoftext|",
    "ΣΑΣ ΟΔΟΣ İ",
    "a" * 5000,
    "abab" * 77,
    "don't 'LL x's 'S",
    "é" * 300,
    "$#@!" * 999,
    "\x1c\x85 x\x1fy",
    "é <|endoftext|>́",
    "\x00\x01 \x7f",
    "1234 ½ ², 漢字 한글 \U0001f600",
]


@pytest.mark.parametrize("text", TEXTS)
def test_awkward_texts(library, own, text):
    same(library, own, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(library, own, text):
    same(library, own, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefghinorst", min_size=1, max_size=120))
def test_short_and_long_merges_agree(own, word):
    ids = [own.inner[b] for b in word.encode()]
    assert bpe.merge_short([*ids], own.pairs) == bpe.merge_long([*ids], own.pairs)


def test_every_document(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op4_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_awkward_rows(awkward, library):
    rows = bpe.encode_digests(awkward, PATH).collect()
    assert len(rows) == awkward.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    ids = {r.doc_id: r.ids for r in bpe.encoded(awkward, PATH).collect()}
    assert ids[5] == library.encode(awkward.where("doc_id = 5").first().text, add_special_tokens=False).ids
    assert ids[2] == []


def test_round_trip_of_columns(awkward, library):
    df = bpe.encoded(awkward, PATH).withColumn("text", bpe.decode(F.col("ids"), PATH))
    for r in df.collect():
        assert r.text == library.decode(r.ids, skip_special_tokens=False)


def test_empty_table(empty_documents):
    assert bpe.encode_digests(empty_documents, PATH).collect() == []
