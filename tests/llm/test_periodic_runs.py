"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs
from tidemark.llm.text_queries import op13_periodic_runs


def brute(words, shortest=6, times=4):
    """All maximal stretches of every period, the smallest period of each kept."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    joined = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(joined.encode()).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


@settings(max_examples=1500, deadline=None)
@given(st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=70)))
def test_small_alphabets(words):
    assert periodic_runs.runs_of(np.array(words, np.int64)) == brute(words)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_powers(powers):
    words = [w for base, times in powers for w in base * times]
    assert periodic_runs.runs_of(np.array(words, np.int64)) == brute(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60), st.sampled_from([(1, 2), (2, 2), (4, 2), (6, 3), (9, 3), (12, 5)]))
def test_other_bounds(words, bounds):
    assert periodic_runs.runs_of(np.array(words, np.int64), *bounds) == brute(words, *bounds)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), max_size=8))
def test_texts_sorted_together_are_apart(texts):
    assert periodic_runs.runs_of_all(texts) == [brute(t) for t in texts]


def test_blocks_of_positions_split(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    draw = random.Random(1)
    for _ in range(60):
        words = draw.choices([0, 1], k=300)
        assert periodic_runs.runs_of(np.array(words)) == brute(words)


@pytest.mark.parametrize("base", [[0], [0, 1], [0, 1, 0], list(range(1000)), [0, 0, 1] * 5 + [2]])
def test_long_texts_take_little_time(base):
    words = np.array((base * 200_000)[:200_000])
    started = time.time()
    assert periodic_runs.runs_of(words) == [(0, 200_000, len(base))] or len(base) in (16, 3)
    draw = np.random.default_rng(2).integers(0, 2, 100_000)
    periodic_runs.runs_of(draw)
    assert time.time() - started < 30


def test_operator_on_odd_rows(spark):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices(["a", "b", "ab", "é", "x\x1cy"], k=draw.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, "x " * 9), (1, "q " * 9), (1, "q " * 9), (203, "la  la\nla\tla\x0bla la la")]
    frame = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, start int, runs string").repartition(3)
    assert rows_of(periodic_runs.run_digests(frame, plant=True)) == sorted((expected(*r) for r in rows), key=str)
    assert periodic_runs.run_digests(frame.limit(0)).collect() == []


def test_collapsed_text(spark):
    frame = spark.createDataFrame([(1, "so no no no no no no well well"), (2, "a b a b a b a b c")], "doc_id long, text string")
    found = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in periodic_runs.collapsed(frame).collect()}
    assert found == {1: ("so no well well", [(1, 6, 1)]), 2: ("a b c", [(0, 8, 2)])}


def test_query_over_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = rows_of(op13_periodic_runs(spark, folder))
    assert found == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in found) > 10
