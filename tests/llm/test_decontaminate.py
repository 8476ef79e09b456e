"""Benchmark windows against a search in plain Python."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate

SCHEMA = "doc_id long, text string, n_hit int, items string, text_key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(documents, items, window=10):
    windows = set()
    for name, text in items:
        found = words(text)
        for start in range(max(1, len(found) - window + 1) if found else 0):
            windows.add(("null" if name is None else str(name), tuple(found[start : start + window])))
    out = []
    for doc_id, text in documents:
        found, hit, names = words(text), set(), set()
        for name, w in windows:
            for start in range(len(found) - len(w) + 1):
                if tuple(found[start : start + len(w)]) == w:
                    names.add(name)
                    hit.update(range(start, start + len(w)))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(found), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(5)
    word = lambda: draw.choice(["the", "of", "é", "x1", "und", "rare%d" % draw.randrange(30)])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 25, 10, 11, 4, 1, 40, 12])]
    items += [(None, "only null names this one"), (9, None), (10, "?!"), (2, items[2][1]), (11, "aa aa aa aa aa aa aa aa aa aa")]
    documents = []
    for i in range(120):
        parts = [word() for _ in range(draw.randrange(60))]
        if i % 3 == 0:
            _, text = draw.choice(items)
            found = words(text)
            at = draw.randrange(max(1, len(found)))
            parts[len(parts) // 2 : 0] = found[at : at + draw.randrange(5, 25)]
        documents.append((i, ("\n" if i % 2 else ", ").join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    documents += [(500, None), (501, ""), (None, items[0][1]), (502, items[0][1]), (502, items[0][1]), (503, "aa " * 30), (504, "z " * 50000 + items[6][1])]
    return documents, items


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_phrases(spark, tables, block_words):
    documents, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(frame(spark, documents), benchmark, block_words=block_words).drop("text_key")
    assert sorted(map(tuple, out.collect()), key=str) == brute(documents, items)


def test_proximity(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta so gamma delta"), (3, "beta alpha gamma delta"), (4, "alpha one two three beta gamma delta"), (5, "alpha")]
    near = decontaminate.contamination(frame(spark, rows), benchmark, slack=1)
    assert {r.doc_id: r.contaminated for r in near.collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_stage_drops_hit_texts_only(spark, tables):
    documents, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = {(r[0], r[1]) for r, b in zip(documents, [brute([d], items)[0][5] for d in documents], strict=True) if not b}
    out = decontaminate.without_contaminated(frame(spark, documents), benchmark)
    assert out.columns == ["doc_id", "text", "n_hit", "items", "text_key"]
    assert {(r.doc_id, r.text) for r in out.collect()} == clean


def test_empty_tables(spark, tables):
    documents, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(frame(spark, documents).limit(0), benchmark).collect() == []
    out = decontaminate.contamination(frame(spark, documents), benchmark.limit(0)).collect()
    assert len(out) == len(documents) and not any(r.contaminated or r.n_hit or r.n_items for r in out)
