"""Near-duplicate classes against all pairs in plain Python."""

import random

import numpy as np
import pytest

from tidemark.llm import near_dedup

SCHEMA = "doc_id long, text string, component_id int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        name = ids.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), name, not sets[i] or doc_id == name))
    return sorted(out, key=str)


def got(spark, rows, **options):
    return sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows), **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Families of copies, some a chain of small edits, some far from each other; and texts of their own."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    rows, number = [], 1000
    for size, length, edits in ((60, 150, 4), (40, 60, 1), (25, 300, 12), (3, 12, 1), (2, 6, 0)):
        texts = [[word() for _ in range(length)]]
        for _ in range(size):
            copy = list(draw.choice(texts))
            for _ in range(draw.randint(0, edits)):
                copy[draw.randrange(length)] = word()
            texts.append(copy)
        for t in texts:
            rows.append((number, " ".join(t)))
            number += 1
    rows += [(number + i, " ".join(word() for _ in range(40))) for i in range(60)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_all_pairs(spark, corpus, percent):
    assert got(spark, corpus, percent=percent) == brute(corpus, percent)


def test_edge_cases(spark):
    rows = [
        (None, None), (1, ""), (2, "a b"), (3, "A  b"), (None, "a b"), (4, None), (4, None), (5, " \t\x0b\n"), (6, "É É É É É É"), (7, "é é é é é é"),
        (8, "x y z " * 20000), (9, "X y Z " * 20000), (9, "X y Z " * 20000), (10, "a\xa0b"), (10, "other words that are six here"),
    ]
    assert got(spark, rows) == brute(rows)
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_one_row_of_each_class_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, None), (3, None), (4, "x"), (None, "x")]
    out = near_dedup.without_copies(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "component_id", "id"]
    assert sorted(tuple(r)[:2] for r in out.collect()) == [(1, "a b c d e f"), (3, None), (3, None), (4, "x")]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000 + i, 1000) for i in range(50)] + [(2000, 2000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    out = {r.id: r.component for r in near_dedup.components(frame).collect()}
    assert all(out[i] == 0 for i in range(401)) and all(out[1000 + i] == 1000 for i in range(50))


def test_equal_sets_get_equal_bands():
    sketch, hashes = near_dedup.Sketch(), near_dedup._WordHashes()
    for text in ("one two", "a b c d e f g", "w " * 500 + "end"):
        a, b = (near_dedup.shingle_set(t, hashes) for t in (text, text.upper()))
        assert (sketch.bands_of(a) == sketch.bands_of(b)).all()


@pytest.mark.parametrize("percent", [85, 80])
def test_no_link_is_lost_before_the_full_sets(spark, percent):
    """Pairs right at the threshold, each a family of its own: every one must come out."""
    draw = np.random.default_rng(5)
    size, pairs = 185 if percent == 85 else 180, 3000
    shared = size * 2 * percent // (100 + percent)  # of each set; |A & B| / |A | B| is the threshold or just above
    while 100 * shared < percent * (2 * size - shared):
        shared += 1
    members, sets = [], []
    for i in range(pairs):
        values = draw.integers(0, 2**64, 2 * size - shared, dtype=np.uint64)
        for own, found in ((2 * i, values[:size]), (2 * i + 1, values[size - shared :])):
            found = np.unique(found)
            members.append((i, own))
            sets.append((own, len(found), found.view(np.int64).tolist(), near_dedup.parities(found).tolist()))
    links = near_dedup.link_families(
        spark.createDataFrame(members, "family long, id long"),
        spark.createDataFrame(sets, "id long, n long, shingles array<long>, bits array<long>").repartition(4), percent,
    )
    assert sorted(tuple(sorted(r)) for r in links.collect()) == [(2 * i, 2 * i + 1) for i in range(pairs)]


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(6)
    for size in (1, 5, 100, 3000, 50000):
        a, b = (np.unique(draw.integers(0, 2 * size, size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = np.bitwise_count((near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_large_family_is_dealt_to_salts(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "SALTED", 8)
    assert got(spark, corpus) == brute(corpus)
