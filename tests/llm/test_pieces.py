"""Against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from concord.llm import pieces, queries
from concord.llm.base import table

PATH = queries.pieces_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.model(pieces.definition(PATH))


def same(library, own, texts):
    for text, (found, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        ids = library.encode(text or "", add_eos=True)
        mine = [int(k) for k in found.split()] + [own.end]
        assert mine == ids, repr(text)
        assert decoded == own.decode(mine) == library.decode(ids), repr(text)


TEXTS = [
    None,
    "",
    " ",
    "\n",
    "  two  blanks  ",
    "▁ marks ▁▁ of ▁ blanks▁",
    "<s> </s> <unk> <0x0A> <pad>",
    "ΣΑΣ İ ß 漢字 한글 \U0001f600\U0001f600",
    "\x00\x01\x1c\x85 ",
    "don't\tdo\r\nthat",
    "a" * 50_000,
    "ab" * 3_000,
    " " * 20_001,
    "word " * 30_000,
    "漢" * 5_000,
]


def test_awkward_texts(library, own):
    same(library, own, TEXTS)
    for n in range(40):
        same(library, own, [" " * n, " " * n + "the", "x" + " " * n + "\n" + " " * n])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_any_text(library, own, texts):
    same(library, own, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aaeeinorst ▁.\n", max_size=200))
def test_merges_that_overlap(library, own, text):
    same(library, own, [text])


def test_pieces_in_a_row(library, own):
    some = random.Random(1)
    known = [library.id_to_piece(k) for k in range(library.get_piece_size())]
    same(library, own, ["".join(some.choices(known, k=20)) for _ in range(2_000)])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999), st.sampled_from([259, 28_705])), max_size=9))
def test_any_ids(library, own, ids):
    assert own.decode(ids) == library.decode(ids)


def test_a_full_cache_and_long_chunks(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(pieces, "FLAT_CHARS", 10)
    fresh = pieces.Model(pieces.definition(PATH))
    for _ in range(3):
        same(library, fresh, ["some words of one text", "x" * 500 + " words", "and some more words", "x" * 500])
    assert all(len(c) <= pieces.LONG_CHUNK for c in fresh.chunk_ids)


def test_every_document(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op13_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_awkward_rows(awkward, library):
    rows = pieces.encode_digests(awkward, PATH).collect()
    assert len(rows) == awkward.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    ids = {r.doc_id: r.ids for r in pieces.encoded(awkward, PATH).collect()}
    assert ids[5] == library.encode(awkward.where("doc_id = 5").first().text, add_eos=True)
    assert ids[2] == ids[3] == [2]


def test_round_trip_of_columns(awkward, library):
    df = pieces.encoded(awkward, PATH).withColumn("text", pieces.decode(F.col("ids"), PATH))
    for r in df.collect():
        assert r.text == library.decode(r.ids)


def test_empty_table(empty_documents):
    assert pieces.encode_digests(empty_documents, PATH).collect() == []
    assert pieces.encoded(empty_documents, PATH).collect() == []


def test_other_files_are_refused(own):
    from sentencepiece import sentencepiece_model_pb2 as files

    changed = files.ModelProto()
    changed.ParseFromString(pieces.definition(PATH))
    changed.pieces[300].score = changed.pieces[301].score
    with pytest.raises(ValueError, match="one score"):
        pieces.Model(changed.SerializeToString())
    changed.ParseFromString(pieces.definition(PATH))
    changed.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="normaliser"):
        pieces.Model(changed.SerializeToString())
