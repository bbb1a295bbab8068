import hashlib
import struct

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import edges
from glyphlake.llm import bpe, queries, token_counts
from glyphlake.llm.common import ARROW_BYTES, ARROW_SETTING, by_bytes, small_batches

sentencepiece = pytest.importorskip("sentencepiece")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

MODEL = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file(None))
RANKS = bpe.read_ranks(bpe.ranks_file(None))
ENCODER = bpe.PieceEncoder(RANKS, cache=50)
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = regex.compile(P.PATTERN).findall


def ids(text):
    data = bpe.encode_text(text, ENCODER, SPLIT)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abcdefgh  \n'stre", max_size=200))
def test_bpe_is_tiktoken(text):
    assert ids(text) == PLAIN.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "ab" * 3000, "字" * 1500, "thethethe" * 400, "<|endoftext|> <s>", "\x1c\x85 　x"])
def test_bpe_on_hard_texts(text):
    assert ids(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_backtracking_is_merging(data):
    text = data.decode("latin-1")
    want = bpe.merge_by_rank(data, RANKS)
    assert ENCODER.backtrack(text, [], 0, ENCODER.longest(text, 0)) == want and (ENCODER.encode(text) == want or data in RANKS)


def test_bpe_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = PLAIN.encode_ordinary(d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_bpe_edges(spark):
    got = bpe.decode_documents(bpe.encode_documents(edges.rows(spark))).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in got) == sorted((i or 0, t or "") for i, t in edges.ROWS)
    assert bpe.decode_documents(bpe.encode_documents(edges.empty(spark))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 Z é字▁\n", max_size=400), st.integers(5, 60))
def test_counts_add_up_over_segments(text, limit):
    assert sum(len(MODEL.encode(s)) for s in token_counts.segments(text, limit)) == len(MODEL.encode(text))


@given(st.lists(st.text(alphabet="aé字", max_size=30), max_size=30), st.integers(1, 50))
def test_batches_are_balanced_by_bytes(texts, limit):
    batches = list(by_bytes(enumerate(texts), limit))
    assert [t for b in batches for _, t in b] == texts
    assert all(len(b) == 1 or sum(len(t.encode()) for _, t in b) <= limit for b in batches)


def test_model_can_be_cut():
    assert token_counts.splits_at_spaces(MODEL)


def test_token_count_query(spark, sf_dir):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op1_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {d["doc_id"]: (len(d["text"].encode()), n := len(MODEL.encode(d["text"])), n > 4096) for d in docs}


def test_token_count_edges(spark):
    got = token_counts.count_tokens(edges.rows(spark), batch_bytes=1000, segment_chars=500).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == sorted((i or 0, len((t or "").encode()), len(MODEL.encode(t or ""))) for i, t in edges.ROWS)
    assert token_counts.count_tokens(edges.empty(spark)).count() == 0


def test_what_workers_keep(spark):
    """A task leaves no pieces in its worker; Spark hands over small batches, or those that the session asks for."""
    docs = spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "concat(id, repeat(' one two', 500)) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def left(batches):
        for _ in batches:
            encoder = bpe._encoder(bpe.ranks_file(None))
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder.young) + len(encoder.old)])], names=["n"])

    spark.conf.unset(ARROW_SETTING)
    assert bpe.encode_documents(docs.repartition(8)).where("n_tokens > 0").count() == 4000
    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) <= 1.1 * ARROW_BYTES
    assert max(r["n"] for r in spark.range(64, numPartitions=32).mapInArrow(left, "n long").collect()) == 0
    spark.conf.set(ARROW_SETTING, "1m")
    small_batches(spark)
    assert spark.conf.get(ARROW_SETTING) == "1m"
    spark.conf.unset(ARROW_SETTING)
