"""Benchmark decontamination over a positional inverted index of the documents.

The index is split by documents: a row holds the postings of a few hundred documents, term by term, as
compressed gaps between word positions. Test windows are looked up in every row: the postings of the
window's rarest term there, shifted by its place in the window, are intersected with those of the next
rarer term, and so on; what is left are the places where the whole window stands. With a slack, each word may
stand that far from its place (proximity). The test set is worked off in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, sliced, written
from tidemark.llm.near_dedup import text_key

WINDOW = 10
DOCUMENTS_PER_ROW = 512
BYTES_PER_ROW = 4 << 20  # of text, after which a row is closed
BLOCK_WORDS = 500_000  # of the test set, looked up at a time
PIECE_WORDS = 20_000  # of an item, kept together

# A-Z to a-z; ASCII characters that are no letter or digit to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)

_INDEX = (
    "block long, doc_ids array<long>, text_keys array<string>, n_words array<long>, "
    "terms binary, counts binary, postings binary"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _postings(documents: list[list[bytes]], gap: int) -> tuple[bytes, bytes, bytes]:
    """Terms, number of their postings, and the postings as gaps; documents lie ``gap`` positions apart."""
    numbers = _Numbers()
    sizes = [len(d) for d in documents]
    ids = np.fromiter((n for d in documents for n in map(numbers.__getitem__, d)), np.uint32, sum(sizes))
    places = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
    ordered = places[np.argsort(ids, kind="stable")].astype(np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    gaps = np.diff(ordered, prepend=np.uint32(0))
    return pack(b" ".join(numbers)), pack(np.bincount(ids, minlength=len(numbers)).astype("<u4").tobytes()), pack(gaps.astype("<u4").tobytes())


def build_index(documents: DataFrame, gap: int = 4 * WINDOW) -> DataFrame:
    """Index rows of all documents (``doc_id``, ``text``), checkpointed. ``gap``: more than a window and its slack."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), count()

        def row():
            packed = _postings([w for _, _, w in held], gap)
            ids, keys, sizes = [i for i, _, _ in held], [k for _, k, _ in held], [len(w) for _, _, w in held]
            values = [task << 32 | next(number), ids, keys, sizes, *packed]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)],
                names=["block", "doc_ids", "text_keys", "n_words", "terms", "counts", "postings"],
            )

        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        held, size = [], 0
        for batch in sliced(batches):
            for doc_id, text, key in zip(*batch.columns, strict=True):
                text = text.as_py()
                held.append((doc_id.as_py(), key.as_py(), words_of(text)))
                size += len(text or "")
                if len(held) >= DOCUMENTS_PER_ROW or size >= BYTES_PER_ROW:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return cut(documents.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text"))).mapInArrow(run, _INDEX))


def test_pieces(items: DataFrame, window: int) -> DataFrame:
    """``bucket_key, name, words, n``: the test set (``item_id``, ``text``) in pieces of bounded size that hold each of its windows once.

    ``words`` are joined by blanks, ``n`` counts them. Items without words have no piece; a null ``item_id`` is named ``null``.
    """

    def run(batches):
        for batch in sliced(batches):
            rows = {"bucket_key": [], "name": [], "words": [], "n": []}
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                for start in range(0, max(1, len(found) - window + 1) if found else 0, PIECE_WORDS):
                    piece = found[start : start + PIECE_WORDS + window - 1]
                    rows["bucket_key"].append(start)
                    rows["name"].append("null" if name is None else name)
                    rows["words"].append(b" ".join(piece))
                    rows["n"].append(len(piece))
            types = [pa.int64(), pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return items.select(F.col("item_id").cast("string").alias("name"), "text").mapInArrow(run, "bucket_key long, name string, words binary, n long")


def test_blocks(items: DataFrame, window: int, words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """Pieces of the test set in blocks of about ``words`` words, which the driver holds and broadcasts one at a time.

    Tasks cut the pieces and count words per bucket; the driver sees one row per bucket (four a block), then the rows of
    the buckets that fill a block.
    """
    pieces = written(test_pieces(items, window), "test-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, 4 * (total // words + 1))
    bucket = F.pmod(F.xxhash64("name", "bucket_key", "words"), F.lit(buckets))
    sizes = sorted(tuple(r) for r in pieces.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).limit(buckets).collect())
    start, held = 0, 0
    for i, (number, n) in enumerate(sizes):
        held += n
        if held >= words or i == len(sizes) - 1:
            block = pieces.where(bucket.between(start, number)).select("name", "words")
            yield [(r.name, bytes(r.words)) for r in block.limit(held).collect()]  # a piece has a word at least
            start, held = number + 1, 0


class _Windows:
    """The windows of a block, their terms numbered, grouped by length."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int):
        self.numbers = _Numbers()
        rows: dict[int, list[np.ndarray]] = {}
        names: dict[int, list[str]] = {}
        for name, words in pieces:
            ids = np.array([self.numbers[x] for x in words.split(b" ")])
            own = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
            rows.setdefault(own.shape[1], []).append(own)
            names.setdefault(own.shape[1], []).extend([name] * len(own))
        self.by_length = {length: (np.concatenate(rows[length]), names[length]) for length in sorted(rows)}


def _found(windows: _Windows, terms: bytes, counts: bytes, postings: bytes, slack: int) -> Iterator[tuple[str, int, np.ndarray]]:
    """Item, window length and the places where a window stands, for one index row."""
    unpack = zstandard.ZstdDecompressor().decompress
    number = windows.numbers.get
    ours = np.array([number(t, -1) for t in unpack(terms).split(b" ")])
    sizes = np.frombuffer(unpack(counts), "<u4").astype(np.int64)
    known = np.flatnonzero(ours[: len(sizes)] >= 0)
    places = np.cumsum(np.frombuffer(unpack(postings), "<u4"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    often, start = np.zeros(len(windows.numbers), np.int64), np.zeros(len(windows.numbers), np.int64)
    often[ours[known]], start[ours[known]] = sizes[known], ends[known] - sizes[known]
    for length, (matrix, names) in windows.by_length.items():
        frequency = often[matrix]
        for w in np.flatnonzero(frequency.min(axis=1)):
            at = None
            for offset in np.argsort(frequency[w], kind="stable"):
                term = matrix[w, offset]
                own = places[start[term] : start[term] + often[term]] - offset
                if at is None:
                    at = own if not slack else np.unique(own[:, None] + np.arange(-slack, slack + 1))
                else:
                    near = np.minimum(np.searchsorted(own, at - slack), len(own) - 1)
                    at = at[np.abs(own[near] - at) <= slack]
                if not len(at):
                    break
            if len(at):
                yield names[w], length, at


def matches(index: DataFrame, pieces: list[tuple[str, bytes]], window: int = WINDOW, slack: int = 0, gap: int = 4 * WINDOW) -> DataFrame:
    """``block, place, items, spans`` of every document with a window in it; spans are ``[start, end)`` of words."""
    shared = index.sparkSession.sparkContext.broadcast(pieces)  # a block: each word once, windows are cut in the tasks

    def run(batches):
        ready = _Windows(shared.value, window)
        for batch in sliced(batches, 4):
            rows = {"block": [], "place": [], "items": [], "spans": []}
            for block, n_words, *packed in zip(*batch.columns, strict=True):
                sizes = np.array(n_words.as_py(), np.int64)
                firsts = np.cumsum(sizes + gap) - sizes - gap
                items: dict[int, set] = {}
                spans: dict[int, set] = {}
                for name, length, at in _found(ready, *(x.as_py() for x in packed), slack):
                    documents = np.searchsorted(firsts, at + slack, side="right") - 1
                    for document, first in zip(documents.tolist(), (at - firsts[documents]).tolist(), strict=True):
                        items.setdefault(document, set()).add(name)
                        spans.setdefault(document, set()).add((max(first - slack, 0), min(first + length + slack, int(sizes[document]))))
                for document, names in items.items():
                    rows["block"].append(block.as_py())
                    rows["place"].append(document)
                    rows["items"].append(sorted(names))
                    rows["spans"].append([{"s": s, "e": e} for s, e in sorted(spans[document])])
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return index.select("block", "n_words", "terms", "counts", "postings").mapInArrow(
        run, "block long, place long, items array<string>, spans array<struct<s:long,e:long>>"
    )


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``documents``.

    Words are runs of lower-cased ASCII letters, digits and all characters beyond ASCII; an item's windows
    are its runs of ``window`` words, or the whole item if it is shorter. ``n_hit`` counts the document's
    words inside any window found, each once; ``n_items`` the names of the items found. Null and empty
    texts have no words; repeated rows and null ids are judged like any row; without items nothing is hit.
    """
    gap = 2 * (window + slack) + 2
    index = build_index(documents, gap)
    parts = [cut(matches(index, block, window, slack, gap)) for block in test_blocks(items, window, block_words)]
    rows = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("place", "row")).select(
        "block", F.col("place").cast("long").alias("place"), F.col("row.doc_ids").alias("doc_id"),
        F.col("row.text_keys").alias("text_key"), F.col("row.n_words").alias("n_words"),
    )
    if parts:
        every = parts[0]
        for more in parts[1:]:
            every = every.union(more)
        hits = every.groupBy("block", "place").agg(
            F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
        )
        rows = rows.join(hits, ["block", "place"], "left")
    else:
        rows = rows.select("*", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<struct<s:long,e:long>>").alias("spans"))
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'upto', 0L), (a, x) -> named_struct("
        "'n', a.n + greatest(0L, x.e - greatest(x.s, a.upto)), 'upto', greatest(a.upto, x.e)), a -> a.n)"
    )
    names = F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        F.col("items").isNotNull().alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The rows of ``documents`` in whose text no window of the test set stands; all their columns."""
    found = contamination(documents, items, **options).where("contaminated").select("text_key").distinct()
    key = free_name("text_key", documents.columns)
    bad = cut(found).select(F.col("text_key").alias(key))
    return documents.join(bad, text_key(documents["text"]) == bad[key], "left_anti")
