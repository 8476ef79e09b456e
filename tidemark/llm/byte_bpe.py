"""Byte-level BPE of texts of any length, by overlapping chunks, and the way back.

A long text is cut into chunks that overlap and are dealt to many tasks. Each is split into pre-tokens from its own
first character, which may lie inside a true pre-token. Two splits that share a boundary agree from there
on, so neighbouring chunks are stitched at the first boundary that both have in their overlap; chunks that have none
(a word longer than the overlap) are glued and split again. Only then are the pieces between the stitches
merged by rank. Decoding joins the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, written

CHUNK = 16_384  # characters from the start of a chunk to that of the next
OVERLAP = 512
LOOKAHEAD = 2  # characters past a boundary that the patterns of rank files can look at
CACHED_PIECES = 300_000
LONG_PIECE = 96  # bytes; longer ones are merged with a heap and not kept
IDS_AT_ONCE = 1 << 16
NEVER = 1 << 60

_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_CHUNKS = "row long, doc_id long, no int, start int, own int, text string"
_SPLITS = "row long, no int, start int, own int, head array<int>, tail array<int>"
_PARTS = "row long, doc_id long, no int, ids binary"


def _class_of(escape: str, last: int) -> str:
    """The characters up to ``last`` that ``escape`` stands for in the library that the ids must agree with, as ranges for a set.

    Unicode grows, and engines follow at different times; so the library itself is asked, over all characters at once.
    """
    single = {bytes([b]): b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=escape, mergeable_ranks=single, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.array([ord(c) for c in bytes(probe.encode_ordinary(every)).decode("utf-8")])
    points = points[points <= last]
    cuts = np.flatnonzero(np.diff(points) != 1)
    firsts, lasts = points[np.append(0, cuts + 1)], points[np.append(cuts, len(points) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


def plain_pattern(pattern: str, last: int = 0x10FFFF) -> str:
    """``pattern`` with its character classes spelled out, so that it doesn't depend on the engine that runs it; for texts up to ``last``."""
    ranges = {name: _class_of(name, last) for name in set(re.findall(r"\\p\{\w+\}|\\s", pattern.replace(r"\S", r"\s")))}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ranges:
            out.append(ranges[part] if inside else f"[{ranges[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{ranges[chr(92) + 's']}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a token in base 64 and its rank a line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path}: no token for the bytes {missing[:5]}")
    return ranks


def load(path: str, pattern: str) -> dict:
    """Ranks, the pairs that merge and the spelled-out pattern; fit for a broadcast."""
    ranks = load_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
    return {
        "ranks": ranks, "keys": keys, "products": np.array([pairs[k] for k in keys.tolist()], np.int64),
        "single": np.array([ranks[bytes([b])] for b in range(256)], np.int64),
        "pattern": plain_pattern(pattern), "narrow": plain_pattern(pattern, 0xFFFF),
    }


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece, with a heap of pairs over a linked list, in n log n.

    The neighbours whose union has the lowest rank merge first, the leftmost of equal ones.
    """
    size = len(piece)
    end = list(range(1, size + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, size))

    def rank_at(start: int) -> int | None:
        middle = end[start]
        return ranks.get(piece[start : end[middle]]) if middle < size else None

    heap = [(rank, i) for i in range(size - 1) if (rank := rank_at(i)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, start = heapq.heappop(heap)
        if not end[start] or rank_at(start) != rank:
            continue  # one of its parts has grown since
        middle = end[start]
        end[start], end[middle] = end[middle], 0
        if end[start] < size:
            before[end[start]] = start
        for near in (before[start], start):
            if near >= 0 and (fresh := rank_at(near)) is not None:
                heapq.heappush(heap, (fresh, near))
    out, at = [], 0
    while at < size:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class PieceMerger:
    """Merges many pieces at once: in each step every piece merges its first pair of lowest rank."""

    def __init__(self, spec: dict):
        self.keys, self.single = np.append(spec["keys"], np.iinfo(np.int64).max), spec["single"]
        self.products = np.append(spec["products"], NEVER)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[at] == pairs, self.products[at], NEVER)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (of a byte or more), as little-endian 32-bit integers."""
        sizes = np.array([len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), sizes)
        ranks = np.full(len(ids), NEVER)  # of the pair that starts here
        inner = np.flatnonzero(of[:-1] == of[1:])
        ranks[inner] = self._ranks(ids[inner], ids[inner + 1])
        done = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            counts = np.diff(np.append(starts, len(ids)))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            ready = lowest == NEVER
            if ready.any():
                done.append((of[ready], ids[ready]))
                ids, of, ranks, lowest = (x[~ready] for x in (ids, of, ranks, lowest))
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == lowest)
            at = at[np.append(True, of[at[1:]] != of[at[:-1]])]
            ids[at] = ranks[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, of, ranks = ids[stay], of[stay], ranks[stay]
            at = at - np.arange(len(at))
            for near in (at, at[at > 0] - 1):
                pair = (near + 1 < len(ids)) & (of[near] == of[np.minimum(near + 1, len(of) - 1)])
                ranks[near[~pair]] = NEVER
                ranks[near[pair]] = self._ranks(ids[near[pair]], ids[near[pair] + 1])
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        packed = ids[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        cuts = np.append(0, np.cumsum(np.bincount(of, minlength=len(pieces)))).tolist()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Pre-tokens and ids of texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, spec: dict):
        self.ranks, self.merge = spec["ranks"], PieceMerger(spec)
        self.wide, self.narrow = re.compile(spec["pattern"]), re.compile(spec["narrow"])
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text. Sets without characters beyond U+FFFF are looked up much faster."""
        return (self.wide if _BEYOND.search(text) else self.narrow).findall(text)

    def boundaries(self, text: str) -> np.ndarray:
        """Where pre-tokens start and end, when the text is split from its first character."""
        return np.append(0, np.cumsum([len(p) for p in self.pieces(text)], dtype=np.int64))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Pieces of ordinary length are merged for all texts together and remembered (a bounded number)."""
        rows = [self.pieces(t or "") for t in texts]
        wanted = set().union(*rows)
        if len(self.known) + len(wanted) > CACHED_PIECES:
            self.known = {}
        new = {p: p.encode("utf-8") for p in wanted.difference(self.known)}
        short = [p for p, data in new.items() if len(data) <= LONG_PIECE]
        if short:
            self.known.update(zip(short, self.merge([new[p] for p in short]), strict=True))
        long = {p: np.array(merged_long(data, self.ranks), "<u4").tobytes() for p, data in new.items() if len(data) > LONG_PIECE}
        ids_of = self.known.__getitem__ if not long else lambda p: long[p] if p in long else self.known[p]
        return [b"".join(map(ids_of, pieces)) for pieces in rows]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Raw bytes of ids; they go in by parts of any size."""

    def __init__(self, spec: dict):
        self.tokens = {i: token for token, i in spec["ranks"].items()}

    def decode(self, ids: bytes) -> Iterator[bytes]:
        numbers = np.frombuffer(ids, "<u4")
        for start in range(0, len(numbers), IDS_AT_ONCE):
            yield b"".join(map(self.tokens.__getitem__, numbers[start : start + IDS_AT_ONCE].tolist()))


def _whole(documents: DataFrame, shared, chunk: int) -> DataFrame:
    """Ids of the texts of one chunk, which need no stitches; a null text has none."""

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in sliced(batches):
            ids = pa.array(encoder.encode_all(batch.column(2).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), ids], names=["row", "doc_id", "no", "ids"])

    short = F.coalesce(F.length("text"), F.lit(0)) <= chunk
    rows = documents.where(short).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text", F.lit(0).alias("no"))
    return rows.mapInArrow(run, _PARTS)


def cut_chunks(documents: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of the texts of more than ``chunk`` characters, written to shared space and dealt to all tasks.

    A chunk starts every ``chunk`` characters and reaches ``overlap`` into the next; ``own`` is its length up to
    the start of the next, null for the last one of a text. ``row`` tells the rows of ``documents`` apart.
    """

    def run(batches):
        for batch in sliced(batches, 16):
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, len(text), chunk)
                for group in range(0, len(starts), 64):  # a row of any length goes out by parts
                    some = starts[group : group + 64]
                    last = starts[-1]
                    values = {
                        "row": [row] * len(some), "doc_id": [doc_id] * len(some), "no": [s // chunk for s in some], "start": list(some),
                        "own": [None if s == last else chunk for s in some], "text": [text[s : s + chunk + overlap] if s < last else text[s:] for s in some],
                    }
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values.values(), types, strict=True)], names=list(values))

    rows = documents.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(run, _CHUNKS).repartition("row", "no"), "bpe-chunks")


def split(chunks: DataFrame, shared, overlap: int) -> DataFrame:
    """``row, no, start, own, head, tail``: boundaries of each chunk in the overlap with the chunk before and in that with the next,
    as positions in the text."""

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in sliced(batches):
            heads, tails = [], []
            for start, own, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                at = encoder.boundaries(text)
                if own is not None:  # what a boundary near the end depends on may lie behind the end
                    at = at[at <= len(text) - LOOKAHEAD]
                heads.append((start + at[at <= overlap]).tolist())
                tails.append([] if own is None else (start + at[at >= own]).tolist())
            kept = [batch.column(i) for i in (0, 1, 2, 3)]
            arrays = [*kept, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "no", "start", "own", "head", "tail"])

    return written(chunks.select("row", "no", "start", "own", "text").mapInArrow(run, _SPLITS), "bpe-splits")


def seams(splits: DataFrame) -> DataFrame:
    """``row, no, own, first, last``: where each chunk's pieces begin and end, as positions in the text.

    ``last`` is the first boundary in the overlap that the chunk and the next one share, ``first`` that of the chunk before;
    null where there is none, and at the end of a text.
    """
    order = Window.partitionBy("row").orderBy("no")  # a row per chunk, without its text
    stitched = splits.withColumn("last", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    first = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.lag("last").over(order))
    return written(stitched.withColumn("first", first).select("row", "no", "own", "first", "last"), "bpe-seams")


def glued(chunks: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without a common boundary as one, from the last before them that has its own; and ``row, no`` of all that went into these."""
    order = Window.partitionBy("row").orderBy("no")
    groups = found.select("row", "no", F.sum(F.col("first").isNotNull().cast("int")).over(order).alias("group"))
    many = groups.withColumn("members", F.count("*").over(Window.partitionBy("row", "group"))).where("members > 1").select("row", "no", "group")
    parts = F.array_sort(F.collect_list(F.struct("no", "start", "own", "text", "doc_id")))
    by_group = chunks.join(many, ["row", "no"]).groupBy("row", "group").agg(parts.alias("parts"))
    text = F.expr("array_join(transform(parts, (x, i) -> if(i = size(parts) - 1, x.text, substring(x.text, 1, x.own))), '')")
    own = F.expr("if(element_at(parts, -1).own is null, null, element_at(parts, -1).start + element_at(parts, -1).own - parts[0].start)")
    together = by_group.select("row", F.expr("parts[0].doc_id"), F.expr("parts[0].no"), F.expr("parts[0].start"), own.alias("own"), text.alias("text"))
    return written(together.toDF(*chunks.columns), "bpe-chunks"), many.select("row", "no")


def _parts(documents: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """Ids of the texts of several chunks, a row per chunk."""
    chunks = cut_chunks(documents, chunk, overlap)
    splits = split(chunks, shared, overlap)
    while True:
        found = seams(splits)
        if found.where("last is null and own is not null").isEmpty():
            break
        new, gone = glued(chunks, found)
        chunks = chunks.join(gone, ["row", "no"], "left_anti").select(*chunks.columns).union(new)
        splits = splits.join(gone, ["row", "no"], "left_anti").select(*splits.columns).union(split(new, shared, overlap))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in sliced(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True)
            ids = encoder.encode_all([text[first - start : None if last is None else last - start] for start, text, first, last in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["row", "doc_id", "no", "ids"])

    pieces = chunks.join(found.select("row", "no", "first", "last"), ["row", "no"])
    return pieces.select("row", "doc_id", "no", "start", "text", "first", "last").mapInArrow(run, _PARTS)


def encoded(documents: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``row, doc_id, no, ids``: ids of the texts of ``documents`` in parts, ``no`` in their order, 0 only for texts of one chunk.

    ``ids`` are little-endian unsigned 32-bit integers. ``row`` tells rows of equal ``doc_id`` apart (with ``no`` above 0 or
    several parts; it is drawn per branch). Null and empty texts have one part without ids.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(path, pattern))
    return _whole(documents, shared, chunk).union(_parts(documents, shared, chunk, overlap))


def _digests(parts: DataFrame, shared) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; the parts of a text must follow each other."""

    def pieces(batches):
        for batch in sliced(batches, 64):
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)

    def result(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        decoder, done = Decoder(shared.value), []
        for _, parts_of_text in groupby(pieces(batches), key=lambda p: p[0]):
            n, ids_digest, text_digest, doc_id = 0, hashlib.sha256(), hashlib.sha256(), None
            for _, doc_id, ids in parts_of_text:
                n += len(ids) // 4
                ids_digest.update(ids)
                for data in decoder.decode(ids):
                    text_digest.update(data)
            done.append((doc_id, n, ids_digest.hexdigest(), text_digest.hexdigest()))
            if len(done) >= 1024:
                yield result(done)
                done = []
        if done:
            yield result(done)

    return parts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(documents: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``documents`` (``doc_id``, ``text``).

    ``path`` is the file of ranks, read by the driver and broadcast (its size is that of the vocabulary), ``pattern`` splits texts
    into pre-tokens that are merged one by one. Null texts count as empty: no tokens, digests of nothing. Texts of
    any length give all their tokens: a text is worked on by many tasks, only the digests pass over its parts in turn. A word of any
    length is merged whole, in one task. Repeated rows give repeated results, a null ``doc_id`` stays null, an empty table
    gives no row, other columns are not read. Chunks and stitches are written to shared space.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(path, pattern))
    parts = _parts(documents, shared, chunk, overlap).repartition("row").sortWithinPartitions("row", "no")
    return _digests(_whole(documents, shared, chunk), shared).union(_digests(parts, shared))


def decoded(parts: DataFrame, path: str) -> DataFrame:
    """``row, doc_id, no, data``: raw bytes of the parts that ``encoded`` gives; joined by ``no`` they are the text."""
    shared = parts.sparkSession.sparkContext.broadcast({"ranks": load_ranks(path)})

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in sliced(batches):
            data = pa.array([b"".join(decoder.decode(ids)) for ids in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], data], names=["row", "doc_id", "no", "data"])

    return parts.select("row", "doc_id", "no", "ids").mapInArrow(run, "row long, doc_id long, no int, data binary")
