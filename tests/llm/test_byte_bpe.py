"""Byte-level BPE against the tiktoken library, and chunked texts against whole ones."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe
from tidemark.llm.text_queries import op11_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SPEC = byte_bpe.load(PATH, PATTERN)
ENCODER, DECODER = byte_bpe.Encoder(SPEC), byte_bpe.Decoder(SPEC)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=SPEC["ranks"], special_tokens={})
ALPHABET = ["a", "the", "Haus", "s", "ll", "'", "’", " ", "  ", "\n", "\t", "　", "\x1c", "7", "½", "٣", "é", "数", "한", "😀", "_", "-", ".", "<|endoftext|>", "ǅ", "՘"]


def library(text):
    return np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()


def expected(rows):
    out = []
    for doc_id, text in rows:
        ids, data = library(text), (text or "").encode("utf-8")
        out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)


@pytest.mark.parametrize("text", ["", " ", "The cat's on the mat, isn't it?  I'll\tgo\n\n", "<|endoftext|>", "数学は難しい 한국어 ½ ² Ⅷ ٣ ४", "a\x1cb\x85d e　f\x00g", "  \n x"])
def test_fixed_texts(text):
    assert ENCODER.encode(text) == library(text)
    assert b"".join(DECODER.decode(library(text))) == text.encode("utf-8")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)))
def test_any_text(text):
    assert ENCODER.encode(text) == library(text)


def test_classes_are_those_of_the_library():
    text = " ".join(map(chr, [*range(0x21, 0xD800), *range(0xE000, 0x110000)]))
    assert ENCODER.encode(text) == library(text)


@pytest.mark.parametrize("piece", ["a" * 3000, "ab" * 2000, "é" * 999, "xyz_" * 700, " " * 5000 + "x"])
def test_long_pieces(piece):
    assert ENCODER.encode(piece) == library(piece)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=96), st.text("aab ", min_size=1, max_size=60).map(str.encode)), min_size=1, max_size=20))
def test_many_pieces_at_once_merge_like_one(pieces):
    expected = [np.array(byte_bpe.merged_long(p, SPEC["ranks"]), "<u4").tobytes() for p in pieces]
    assert ENCODER.merge(pieces) == expected


def texts():
    draw = random.Random(4)
    rows = [(i, "".join(draw.choices(ALPHABET, k=draw.randint(0, 120)))) for i in range(60)]
    rows += [(100, "w" * 700), (101, "a b " * 90 + "é" * 300 + " end" * 60), (102, " " * 400 + "x"), (103, "\n" * 333), (104, "'" * 99 + "ll" * 99)]
    rows += [(105, "don't" * 120), (106, None), (107, ""), (None, "no id " * 30), (100, "w" * 700), (108, "x" * 50), (109, "x" * 51)]
    return rows


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 6), (20, 4), (64, 64)])
def test_chunks_give_the_ids_of_whole_texts(spark, chunk, overlap):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(byte_bpe.tokenized(frame, PATH, PATTERN, chunk, overlap)) == expected(rows)


def test_glued_chunks_are_whole(spark):
    """A word over many chunks has no boundary in any overlap; its neighbours keep theirs."""
    frame = spark.createDataFrame([(1, "one two " * 20 + "z" * 500 + " three four" * 20)], "doc_id long, text string")
    shared = spark.sparkContext.broadcast(SPEC)
    chunks = byte_bpe.cut_chunks(frame, 40, 8)
    splits = byte_bpe.split(chunks, shared, 8)
    found = byte_bpe.seams(splits)
    assert found.where("last is null and own is not null").count() > 8
    joined, gone = byte_bpe.glued(chunks, found)
    assert joined.count() < gone.count() < chunks.count()
    rest = splits.join(gone, ["row", "no"], "left_anti").select(*splits.columns)
    assert byte_bpe.seams(rest.union(byte_bpe.split(joined, shared, 8))).where("last is null and own is not null").count() == 0


def test_parts_decode_to_the_text(spark):
    rows = [r for r in texts() if r[0] not in (100, None)]
    parts = byte_bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN, 50, 6)
    found: dict = {}
    for row in sorted(byte_bpe.decoded(parts, PATH).collect(), key=lambda r: r.no):
        found[row.doc_id] = found.get(row.doc_id, b"") + bytes(row.data)
    assert found == {i: (t or "").encode("utf-8") for i, t in rows}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert result(byte_bpe.tokenized(empty, PATH, PATTERN)) == []
    clash = spark.createDataFrame([(1, "a b", 3, "x", "y")], "doc_id long, text string, no int, ids string, row string")
    assert result(byte_bpe.tokenized(clash, PATH, PATTERN, 2, 2)) == expected([(1, "a b")])


def test_query_over_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op11_byte_bpe(spark, folder)) == expected(rows)
