"""Near-duplicate classes: one-permutation MinHash with optimal densification, banded buckets, star edges.

A document is the set of its five-word shingles. Equal sets collapse first, by a 128-bit digest of the
set, so copies never meet in a bucket. Each distinct set is hashed once; the hashes fall into bins, every
bin keeps its smallest, and an empty bin borrows from the first filled bin in an order of its own, the
same for all documents. Bands of bins name buckets, and sets that buckets connect form a family.

A set most of whose shingles nobody else in the families has can't be linked and is left out. In
the others every set is compared with a few centres of its family (a star), never with all others, and links are confirmed
on the full sets. Stars alone could miss a chain of links, so there are rounds: a centre that has been compared
with everybody leaves, a family whose sets are in one component is finished, the others get more centres. Nothing
is capped; the rounds end when no family has two components left. Each set has a sketch of the parities of its shingle counts
in 1024 buckets. Every bucket in which two sketches differ holds a shingle that only one of the sets has, so pairs that differ in
more buckets than linked sets have such shingles are no links; they are dropped in the join, before the full sets are fetched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, sliced

WIDTH = 5
BANDS = 26
ROWS = 5
CACHED_WORDS = 200_000
CENTRES = 64  # times as many centres of a family in each further round
BITS = 1024  # of a sketch; whether the number of shingles in each of so many buckets is odd
SALTED = 1024  # about so many sets of a family meet their centres in one place

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


class _WordHashes(dict):
    """64-bit hashes of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def shingle_set(text: str | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; one for a text of fewer words, none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = values[: len(words) - width + 1].copy()
    for step in range(1, width):
        total = total * _FACTOR + values[step : len(words) - width + 1 + step]
    return np.unique(_mixed(total + np.uint64(width)))


class Sketch:
    """Band keys of a shingle set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 20):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draw = np.random.default_rng(seed)
        self.lenders = np.stack([draw.permutation(self.bins) for _ in range(self.bins)])
        self.weights = draw.integers(1, 2**63, size=(rows + 1,), dtype=np.uint64) | np.uint64(1)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        bins = ((shingles * _FACTOR) >> np.uint64(40)) % np.uint64(self.bins)
        first = np.full(self.bins, -1)
        first[bins[::-1]] = np.arange(len(shingles) - 1, -1, -1)  # sorted hashes: the smallest of a bin is written last
        filled = first >= 0
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.lenders[empty]
            first[empty] = first[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        lowest = shingles[first].reshape(self.bands, self.rows)
        keys = (lowest * self.weights[: self.rows]).sum(axis=1, dtype=np.uint64)
        return _mixed(keys + np.arange(self.bands, dtype=np.uint64) * self.weights[self.rows]).view(np.int64)


def text_key(text: Column) -> Column:
    """Digest of a text; an empty one for null, so that keys join by plain equality."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def sketches(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, bands`` of every row; no set and no bands without words."""

    def run(batches):
        hashes, sketch = _WordHashes(), Sketch(bands, rows)
        for batch in sliced(batches):
            counts, keys, found = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), hashes, width)
                counts.append(len(shingles))
                keys.append(hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None)
                # A text of fewer words than a shingle can only be equal to another, which the key tells.
                found.append(sketch.bands_of(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text"))).mapInArrow(
        run, "doc_id long, text_key string, n_shingles long, set_key binary, bands array<long>"
    )


def parities(shingles: np.ndarray) -> np.ndarray:
    """One bit for each bucket of hashes, packed: whether it holds an odd number."""
    inside = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((inside & 1).astype(np.uint8)).view(np.int64)


def full_sets(documents: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id, n, shingles, bits`` of the wanted sets: sorted hashes, and the parities of their numbers in ``BITS`` buckets.

    ``wanted`` has ``id``, ``set_key`` and the ``doc_id`` (null too) of a document with that set.
    """

    def run(batches):
        hashes = _WordHashes()
        for batch in sliced(batches):
            keys, sets, bits = [], [], []
            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), hashes, width)
                keys.append(hashlib.md5(shingles.tobytes()).digest())
                sets.append(shingles.view(np.int64))
                bits.append(parities(shingles))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["set_key", "shingles", "bits"],
            )

    chosen = documents.select(F.col("doc_id").cast("long").alias("d"), "text")
    chosen = chosen.join(wanted.select("doc_id").distinct(), F.expr("d <=> doc_id"), "left_semi").select("text")
    made = chosen.mapInArrow(run, "set_key binary, shingles array<long>, bits array<long>").dropDuplicates(["set_key"])
    return made.join(wanted.select("set_key", "id"), "set_key").select("id", F.size("shingles").cast("long").alias("n"), "shingles", "bits")


def supported(sets: DataFrame, percent: int) -> DataFrame:
    """``id`` of the sets that share ``percent`` of their shingles or more with others; the rest have no links."""
    alone = (
        sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id"))
        .where("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    )
    return sets.select("id", "n").join(alone, "id", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("id")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` (with ``x, y``) whose sets overlap by ``percent`` of their union or more."""

    def run(batches):
        for batch in sliced(batches):
            keep = []
            for left, right in zip(batch.column(4), batch.column(5), strict=True):
                a, b = (x.values.to_numpy() for x in (left, right))
                a = a.view(np.uint64)
                at = np.searchsorted(a, b.view(np.uint64))
                shared = int((a[np.minimum(at, len(a) - 1)] == b.view(np.uint64)).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b", "x", "y"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long, x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of an edge ``a, b``: large-star and small-star steps until nothing changes."""

    def counted(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()  # tells number and sum while the pairs are written, without a job of its own
        kept = cut(pairs.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        return kept, (seen.get["n"], seen.get["sum"])

    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    now, state = counted(edges.where("a <> b").select(upper.alias("u"), lower.alias("v")).distinct())
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        now, state = counted(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def link_families(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` that join all sets of a family which are joined by links.

    ``members`` has ``family, id``, ``sets`` what :func:`full_sets` gives. The labels by which a family
    counts as finished are members of the same component, though not always its last name: a merge that is
    seen late costs another comparison, never a link.
    """
    sketch = [F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)]
    alive = members.join(sets.select("id", "n", *sketch), "id").withColumn("component", F.col("id"))
    names = ["family", "id", "n", *(f"bits{i}" for i in range(BITS // 64))]
    links, at = [], 0
    while True:
        draw = F.xxhash64(F.lit(at), "id")
        state = (
            alive.groupBy("family")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.min(draw).alias("first"))
            .where("low < high").select("family", "size", "first")
        )
        # About CENTRES ** at centres of each family, one at least; all its sets if it has no more.
        chosen = (draw == F.col("first")) | (F.pmod(draw, F.col("size")) < CENTRES**at)
        places = F.ceil(F.col("size") / SALTED)
        open_ = cut(alive.join(state, "family").withColumn("centre", chosen).withColumn("draw", draw).withColumn("salt", F.pmod(draw, places)))
        centres = open_.where("centre").select(
            "family", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("salt"), F.col("id").alias("c"), F.col("n").alias("m"), F.col("component").alias("of"), F.col("draw").alias("c_draw"),
            *(F.col(f"bits{i}").alias(f"c_bits{i}") for i in range(BITS // 64)),
        )
        differing = sum((F.bit_count(F.col(f"bits{i}").bitwiseXOR(F.col(f"c_bits{i}"))) for i in range(1, BITS // 64)), F.bit_count(F.col("bits0").bitwiseXOR(F.col("c_bits0"))))
        pairs = (
            open_.join(centres, ["family", "salt"])
            .where("component <> of")
            # |A ^ B| is at least ``differing``, and for linked sets at most (100 - percent) / (100 + percent) of |A| + |B|.
            .where((100 + percent) * differing <= (100 - percent) * (F.col("n") + F.col("m")))
            .where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
            .where("not centre or id < c")  # two centres meet once
            .select(F.col("id").alias("a"), F.col("c").alias("b"), F.col("component").alias("x"), F.col("of").alias("y"))
        )
        found = cut(confirmed(pairs, sets, percent))
        links.append(found.select("a", "b"))
        rest = open_.where("not centre and size > 2").select(*names, "component")
        if rest.isEmpty():
            break
        # The least label two links away: exact for a star.
        ends = found.select(F.col("x").alias("u"), F.col("y").alias("v")).union(found.select("y", "x")).distinct()
        near = ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("v"), F.least("u", "v").alias("least"))
        lower = ends.join(near, "v").groupBy("u").agg(F.min("least").alias("now")).select(F.col("u").alias("component"), "now")
        alive = rest.join(lower, "component", "left").select(*names, F.least("component", F.coalesce("now", "component")).alias("component"))
        at += 1
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return every


def classified(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` of every row of ``documents`` (``doc_id``, ``text``).

    A-Z are lower-cased, words are runs of other characters than space and \\x09-\\x0D. Documents of
    fewer words than a shingle are one shingle; those without words (null and empty texts too) are
    linked with nothing and kept. A null ``doc_id`` is a copy like any other but names no component, unless
    nobody in it has an id: then the name is null and the rows are kept. Rows that share a ``doc_id``
    are judged one by one; equal rows get equal results. Other columns are not read.
    """
    base = cut(sketches(documents, bands, rows, width))
    distinct = base.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"))
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()))  # numbers are fixed by the checkpoint
    bucket_rows = distinct.select("id", F.explode("bands").alias("bucket"))
    shared = bucket_rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1").select("bucket", "first")
    edges = bucket_rows.join(shared, "bucket").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    families = cut(components(edges).select("id", F.col("component").alias("family")))
    sets = cut(full_sets(documents, distinct.join(families, "id", "left_semi").select("id", "set_key", "doc_id"), width))
    linkable = supported(sets, percent)
    linkable = cut(supported(sets.join(linkable, "id", "left_semi"), percent))
    joined = components(link_families(families.join(linkable, "id", "left_semi"), sets, percent))

    classes = distinct.select("id", "set_key", "doc_id").join(joined, "id", "left").select(
        "set_key", "doc_id", F.coalesce("component", "id").alias("class_id")
    )
    names = classes.groupBy("class_id").agg(F.min("doc_id").alias("name"))
    named = classes.join(names, "class_id").select("set_key", "name")
    return base.join(named, "set_key", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
        F.when(F.col("set_key").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("name"))).alias("kept"),
    )


def near_duplicates(documents: DataFrame, **options: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` as told at :func:`classified`."""
    return classified(documents, **options).select("doc_id", "n_shingles", "component_id", "kept")


def without_copies(documents: DataFrame, **options: int) -> DataFrame:
    """``documents`` with one row of each class: that of the smallest ``doc_id``; all its columns.

    Equal rows, and rows that differ in other columns than ``doc_id`` and ``text`` only, leave one row,
    whichever. Rows without words all stay.
    """
    verdicts = classified(documents, **options)
    status = F.when(~F.min("kept"), "drop").when((F.count("*") > 1) & (F.max("n_shingles") > 0), "first")
    flags = cut(
        verdicts.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(status.alias("s")).where("s is not null")
    )
    names = {c: free_name(c, documents.columns) for c in ("d", "k", "s")}
    flags = flags.select(*(F.col(c).alias(n) for c, n in names.items()))
    d, k, s = (flags[n] for n in names.values())
    keyed = documents.join(
        flags, (documents["doc_id"].cast("long").eqNullSafe(d)) & (text_key(documents["text"]) == k), "left"
    )
    single = keyed.where(s.isNull()).select(*(documents[f"`{c}`"] for c in documents.columns))
    if flags.where(F.col(names["s"]) == "first").isEmpty():
        return single
    several = keyed.where(s == "first").dropDuplicates([names["d"], names["k"]])
    return single.union(several.select(*(documents[f"`{c}`"] for c in documents.columns)))
