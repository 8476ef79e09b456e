"""Event keywords and phrases of a vocabulary of any size, found in one pass over each text.

An automaton holds all entries as a trie with failure links (Aho and Corasick), over words instead of characters: keywords count
only between word edges, so a text is cut into its words once, and the automaton reads one word at a time, whatever the number
of entries. A regular expression with as many alternatives would try them one by one at every place.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ENTRIES = 2_000_000
# Words and, in phrases, what stands between them: entries and texts are read alike, so "stock  split" is no "stock split".
_UNITS = re.compile(r"\w+|\W+")


class Automaton:
    """Entries as sequences of words and separators; ``found`` tells which of them occur in a text."""

    def __init__(self, entries: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        self.back: list[int] = [0]
        self.also: list[int] = [0]  # the next node on the way of failures that ends an entry
        for entry in entries:
            node = 0
            for unit in _UNITS.findall(entry):
                after = self.children[node].get(unit)
                if after is None:
                    after = self.children[node][unit] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                    self.back.append(0)
                    self.also.append(0)
                node = after
            if node:
                self.entry[node] = entry
        queue = deque(self.children[0].values())
        while queue:
            node = queue.popleft()
            for unit, child in self.children[node].items():
                queue.append(child)
                at = self.back[node]
                while at and unit not in self.children[at]:
                    at = self.back[at]
                self.back[child] = at = self.children[at].get(unit, 0)
                self.also[child] = at if self.entry[at] is not None else self.also[at]

    def found(self, text: str) -> dict[str, int]:
        """The entries in a text and how often each occurs, overlaps included."""
        node, counts, children = 0, {}, self.children
        for unit in _UNITS.findall(text.lower()):
            while node and unit not in children[node]:
                node = self.back[node]
            node = children[node].get(unit, 0)
            hit = node if self.entry[node] is not None else self.also[node]
            while hit:
                counts[self.entry[hit]] = counts.get(self.entry[hit], 0) + 1
                hit = self.also[hit]
        return counts


def usable_entries(vocabulary: DataFrame, column: str = "keyword") -> list[str]:
    """Entries of a vocabulary table on the driver, lower case and sorted: letters, with single blanks in phrases, longer than two. Their number is checked."""
    low = F.lower(F.trim(column))
    kept = vocabulary.select(low.alias("entry")).where(F.col("entry").rlike(r"^\p{L}+( \p{L}+)*$") & (F.length("entry") > 2)).distinct()
    number = kept.count()
    if number > MAX_ENTRIES:
        raise ValueError(f"{number} keywords; a vocabulary has at most {MAX_ENTRIES}")
    return kept.agg(F.array_sort(F.collect_list("entry")).alias("all")).first()["all"]


def keyword_hits(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, column: str = "keyword") -> DataFrame:
    """``key, keyword, hits``: the usable entries of ``vocabulary`` that occur in every text as whole words, and how often.

    The rule of :func:`functions.text.event_hits`, for vocabularies as a table and for phrases. Texts without a hit, and NULL and empty
    ones, have no row. Texts stay in their rows; the vocabulary is broadcast, its size is checked.
    """
    shared = texts.sparkSession.sparkContext.broadcast(usable_entries(vocabulary, column))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = rows.select("key").schema.add("keyword", T.StringType()).add("hits", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                of, words, hits = [], [], []
                for row, value in enumerate(part.column(1)):
                    for word, number in automaton.found(value.as_py() or "").items():
                        of.append(row)
                        words.append(word)
                        hits.append(number)
                arrays = [part.column(0).take(pa.array(of, pa.int32())), pa.array(words, pa.string()), pa.array(hits, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "keyword", "hits"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def hit_counts(hits: DataFrame, key: str) -> DataFrame:
    """Texts and occurrences of every keyword."""
    return hits.groupBy("keyword").agg(F.count_distinct(key).alias("texts"), F.sum("hits").alias("hits"))
