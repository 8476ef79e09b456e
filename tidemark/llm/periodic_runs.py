"""Periodic runs of words, from repeated suffixes.

Suffixes of the word sequence are sorted; the longest common prefixes (LCP) of neighbours in that order are the edges of a
path. In the order of falling LCP the edges unite classes of suffixes (Kruskal, with union-find); a class keeps its
positions in order. When two classes unite, positions of one become neighbours of positions of the other: if
their distance is within the LCP, the words between them repeat, and a run starts at the left one. The first
such pair with one distance and one end of the common stretch is the run's very start, and the
distance its smallest period, since any smaller one would have put a position between them before.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

SHORTEST, TIMES = 6, 4  # a run has at least SHORTEST words and TIMES periods
BATCH_WORDS = 200_000  # sorted together, so that short texts share the work of a sort
BLOCK = 4096  # positions of a class that are kept in one list


def suffix_order(words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``shortest`` words (or nearly as many) with another one, sorted, and where groups of such start.

    Prefix doubling over those suffixes that are not alone yet: after a round, groups share twice as many words.
    The others share too little with any suffix and never come up. ``words`` ends in a number of its own.
    """
    size = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    first = np.bincount(rank)  # ranks become the place of the group's first suffix
    rank = (np.cumsum(first) - first)[rank]
    order = np.argsort(rank, kind="stable")
    active, places = order, np.arange(size)  # suffixes by place; places that are not settled
    kept, starts, step = None, None, 1
    while True:
        group = rank[active]
        alone = np.append(True, group[1:] != group[:-1]) & np.append(group[:-1] != group[1:], True)
        if step >= shortest // 2 + 1 and kept is None:  # these groups share ``step`` words
            kept, starts = places[~alone], group[~alone]
        active, places = active[~alone], places[~alone]
        if not len(active):
            break
        beyond = active + step  # the last word is unique, so no suffix in a group ends within the step
        key = rank[active] * (size + 1) + rank[beyond]
        by_key = np.argsort(key, kind="stable")
        active, key = active[by_key], key[by_key]
        order[places] = active
        new = np.append(True, key[1:] != key[:-1])
        rank[active] = places[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        step *= 2
    if kept is None:
        kept, starts = places, places
    return order[kept], starts


def common_prefixes(words: list[int], order: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """LCP of each suffix in ``order`` with the one before it; 0 where a group starts.

    Taken in the order of the text, where it falls by at most one from a word to the next (Kasai et al.), so all
    comparisons together are linear.
    """
    before = np.append(-1, order[:-1])
    before[np.append(True, groups[1:] != groups[:-1])] = -1
    by_text = np.argsort(order)
    out, had, last = np.zeros(len(order), np.int64), 0, -2
    for at, left, place in zip(order[by_text].tolist(), before[by_text].tolist(), by_text.tolist(), strict=True):
        had = had - 1 if at == last + 1 and had else 0
        last = at
        if left < 0:
            had = 0
            continue
        while words[at + had] == words[left + had]:
            had += 1
        out[place] = had
    return out


class Positions:
    """Positions of a class in order, in blocks of bounded size."""

    __slots__ = ("blocks", "size")

    def __init__(self, position: int):
        self.blocks, self.size = [[position]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int, int]:
        """Puts a position in and returns its neighbours, -1 where there is none."""
        blocks = self.blocks
        at = 0
        if len(blocks) > 1:
            at = min(bisect_left(blocks, position, key=lambda b: b[-1]), len(blocks) - 1)
        block = blocks[at]
        place = bisect_left(block, position)
        left = block[place - 1] if place else blocks[at - 1][-1] if at else -1
        right = block[place] if place < len(block) else -1
        insort(block, position, place)
        self.size += 1
        if len(block) > BLOCK:
            blocks[at : at + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
        return left, right


def runs_of(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs, by start, then period. ``words`` are numbers; ``times`` is at least 2.

    A run is a stretch with smallest period q, of at least ``shortest`` words and ``times`` times q, that no neighbouring word
    extends. Then its start and the word q further have an LCP of the length less q: at least ``times - 1`` periods, and ``least`` words.
    """
    least = min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))  # the smallest LCP that can make a run
    closed = np.append(words, words.max(initial=0) + 1)
    order, groups = suffix_order(closed, least)
    if not len(order):
        return []
    lcp = common_prefixes(closed.tolist(), order, groups)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], classes[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found: dict[tuple[int, int], int] = {}  # end and period: start
    for a, b, level in zip(order[edges - 1].tolist(), order[edges].tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(a), root(b)
        if classes[a].size < classes[b].size:
            a, b = b, a
        parent[b] = a
        large, reach = classes[a], level // (times - 1)
        before = -1  # of the same class: its pairs with those were seen when it grew
        for position, after in pairwise(chain(classes.pop(b), (len(closed),))):
            left, right = large.add(position)
            if left > before and position - left <= reach and position - left + level >= shortest:
                found.setdefault((position + level, position - left), left)
            if 0 <= right < after and right - position <= reach and right - position + level >= shortest:
                found.setdefault((right + level, right - position), position)
            before = position
    return sorted((start, end - start, period) for (end, period), start in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repetition planted in every tenth document, by its id: from some word on they repeat with some period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode("ascii"))
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def runs_of_all(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, sorted together; a word of its own parts two texts."""
    numbers = _Numbers()
    sizes = [len(t) + 1 for t in texts]
    flat = np.empty(sum(sizes), np.int64)
    at = 0
    for number, words in enumerate(texts):
        flat[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        at += len(words)
        flat[at] = -1 - number
        at += 1
    starts = np.cumsum([0, *sizes])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if at:
        flat -= flat.min()
        for start, length, period in runs_of(flat):
            text = int(np.searchsorted(starts, start, side="right")) - 1
            out[text].append((start - int(starts[text]), length, period))
    return out


def _grouped(batches, limit: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts, in groups of about ``limit`` words."""
    ids, texts, size = [], [], 0
    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # ASCII white space only
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_COLLAPSED = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"


def collapsed(documents: DataFrame, plant: bool = False, text_out: bool = True) -> DataFrame:
    """``doc_id, runs, text``: the runs of every row's words and its words with each run cut to its first period, joined by one space.

    Words are stretches without ASCII white space. Null and empty texts have no words and an empty text. Texts are sorted in groups of
    ``BATCH_WORDS`` words, a longer one by itself: a task holds the words of the longest text, and sorting takes n log n. Repeated rows give
    repeated results, a null ``doc_id`` stays null, other columns are not read. ``plant`` repeats words in every tenth document first
    (by its id). Without ``text_out`` the text is its SHA-256 in hexadecimal.
    """

    def run(batches):
        for ids, texts in _grouped(batches, BATCH_WORDS):
            if plant:
                texts = [planted(words, doc_id) for doc_id, words in zip(ids, texts, strict=True)]
            every = runs_of_all(texts)
            kept = []
            for words, runs in zip(texts, every, strict=True):
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                joined = b" ".join(words)
                kept.append(joined.decode("utf-8", "surrogatepass") if text_out else hashlib.sha256(joined).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in every], kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed, pa.array(kept)], names=["doc_id", "runs", "text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _COLLAPSED)


def run_digests(documents: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id, n_runs``, the longest run (``start, length, period, exponent_milli``; null without one) and digests of all runs and the collapsed text.

    The longest run is the first by start, then period, of those of the greatest length. For the rest see ``collapsed``.
    """
    rows = collapsed(documents, plant, text_out=False)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("fewer"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.select("doc_id", "runs", "text", longest.alias("longest"), listed.alias("listed"))
    length = -F.col("longest.fewer")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        F.col("longest.period").alias("period"), F.floor(length * 1000 / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.col("text").alias("collapsed_sha256"),
    )
