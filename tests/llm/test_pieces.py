"""SentencePiece encoding and decoding against the library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acctpulse.llm import pieces as P

SCHEMA = "doc_id bigint, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def codec():
    return P.codec()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n  \t▁é日😀,.theing\0�<0x>s/|'", max_size=40)))
def test_ids_and_text_are_the_librarys(codec, text):
    ids = codec.library.encode(text)
    assert codec.encode(text).tolist() == ids
    assert codec.decode(ids) == codec.library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.sampled_from([29871, 278, 400, 31999, 1, 0, 13])), max_size=12))
def test_any_ids_decode_as_the_library_does(codec, ids):
    assert codec.decode(ids) == codec.library.decode(ids)


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert P.differences(docs).count() == 0
    got = {r.doc_id: r[1:] for r in P.digests(docs).collect()}
    library = P.codec().library
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert got[r.doc_id] == (len(ids), *sha)


def test_edges(spark, codec):
    long_texts = ["word and " * 300_000, "ab" * 60_000, "x\n" * 100_000, " " * 50_000, ("a" * 70 + "  ") * 20_000]
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "x"), (3, "x"), *((10 + i, t) for i, t in enumerate(long_texts))]
    df = spark.createDataFrame([(*r, "i", 1) for r in rows], SCHEMA).repartition(3)
    got = P.encode(df)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got.collect()) == sorted((i or 0, tuple(codec.library.encode(t or ""))) for i, t in rows)
    back = P.decode(got).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert P.differences(df).count() == 0
    assert P.digests(df).filter(F.col("doc_id") == 1).select("n_tokens").distinct().collect()[0][0] == 0
    assert P.digests(df.limit(0)).count() == 0 == P.encode(df.limit(0)).count()


def test_small_cache_gives_the_same(codec):
    small = P.PieceCodec(cache_chunks=3)
    for text in ["a b c d e f", "the end, of it.", "a b c\nd e", "f e d c b a"] * 2:
        assert small.encode(text).tolist() == codec.library.encode(text)


def test_difference_is_an_error(codec):
    other = P.PieceCodec()
    other.rank = {p: -r for p, r in other.rank.items()}
    with pytest.raises(ValueError, match="differ"):
        other.encode("unbelievable transformations characterize internationalization")
