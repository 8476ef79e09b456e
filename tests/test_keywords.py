"""Keyword automaton against the regular expression and a plain search."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.text import event_hits
from tidemark.operators import keywords
from tidemark.operators.keywords import Automaton

WORDS = ["ban", "bank", "hack", "hacks", "ipo", "Token", "a", "élan", "stock", "split", "stock split", "split stock", "of"]


def plain(text, entries):
    low = text.lower()
    units = re.findall(r"\w+|\W+", low)
    out = {}
    for entry in entries:
        own = re.findall(r"\w+|\W+", entry)
        hits = sum(units[i : i + len(own)] == own for i in range(len(units)))
        if hits:
            out[entry] = hits
    return out


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(WORDS + [" ", "  ", "-", "_", "\n", "BAN", "STOCK", "1"]), max_size=25).map("".join), st.sets(st.sampled_from([w.lower() for w in WORDS])))
def test_equals_a_plain_search(text, entries):
    assert Automaton(sorted(entries)).found(text) == plain(text, entries)


def test_entries_inside_entries():
    found = Automaton(["new york", "york", "new york stock exchange", "stock"]).found("The New York Stock exchange, new york stock")
    assert found == {"new york": 2, "york": 2, "new york stock exchange": 1, "stock": 2}


def test_large_vocabularies_take_one_pass():
    draw = random.Random(1)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(3, 9)))
    vocabulary = sorted({word() for _ in range(100_000)})
    automaton = Automaton(vocabulary)
    text = " ".join(draw.choice(vocabulary) if i % 50 == 0 else word() for i in range(200_000))
    started = time.time()
    found = automaton.found(text)
    assert time.time() - started < 5
    known = set(vocabulary)
    assert sum(found.values()) == sum(w in known for w in text.split())


def test_rule_of_the_expression(spark):
    """On all documents the same keywords as the regular expression finds."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = ["the", "and", "lawsuit", "der", "que", "launch", "token", "été", "x", "no1"]
    got = {}
    for r in keywords.keyword_hits(documents, "doc_id", "text", spark.createDataFrame([(w,) for w in words], "keyword string")).collect():
        got.setdefault(r.doc_id, set()).add(r.keyword)
    want = {r.doc_id: set(r.hits) for r in documents.select("doc_id", event_hits(F.col("text"), words).alias("hits")).collect() if r.hits}
    assert got == want and len(got) > 50


def test_odd_rows_and_vocabularies(spark):
    texts = spark.createDataFrame([(1, "Ban! ban"), (1, "ban"), (2, None), (3, ""), (None, "hack"), (4, "banned")], "id int, keyword string")
    vocabulary = spark.createDataFrame([("BAN",), (" hack ",), (None,), ("",), ("x1",), ("ab",), ("ban",)], "keyword string")
    rows = keywords.keyword_hits(texts, "id", "keyword", vocabulary)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, "ban", 2), (1, "ban", 1), (None, "hack", 1)], key=str)
    assert keywords.keyword_hits(texts, "id", "keyword", vocabulary.limit(0)).collect() == []
    assert keywords.keyword_hits(texts.limit(0), "id", "keyword", vocabulary).collect() == []
    assert {tuple(r) for r in keywords.hit_counts(rows, "id").collect()} == {("ban", 1, 3), ("hack", 0, 1)}


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(keywords, "MAX_ENTRIES", 1)
    with pytest.raises(ValueError, match="2 keywords"):
        keywords.usable_entries(spark.createDataFrame([("aaa",), ("bbb",)], "keyword string"))
