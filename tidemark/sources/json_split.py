"""Elements of JSON arrays in files of any size, read in byte ranges.

A file is read as text with ``}`` for a line end, so that Spark cuts it into ranges like any text. A range does not know whether
it begins inside a string, nor how deep; so a first pass sums it up for either case: how deep it goes, how it ends, and how many
commas stand at which depth. These summaries, one per range, are folded file by file; a second
pass then knows where it begins and cuts the elements out. Those that reach over a range's end are joined; no task holds a file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.DOTALL)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_BARE = re.compile("\\s*\ufeff?\\s*\\[")
_WRAPPED = re.compile(r'"articles"\s*:\s*\[')
_ROWS_AT_ONCE = 1000

_SUMMARY = (
    "path string, block long, found boolean, ends array<boolean>, deltas array<long>, lows array<long>, commas array<map<long,long>>"
)
_START = "path string, block long, quoted boolean, level long, idx long, last boolean"
_PART = "path string, idx long, block long, text string, begins boolean, ends boolean"


def _structure(text: str, at: int, quoted: bool) -> Iterator[tuple[int, str]]:
    """Places and characters of the brackets and commas outside strings; last ``-1`` and whether the text ends in a string."""
    if quoted:
        end = _STRING_END.match(text, at)
        if end is None:
            yield -1, '"'
            return
        at = end.end()
    for found in _TOKEN.finditer(text, at):
        if found[0][0] != '"':
            yield found.start(), found[0]
        elif not found[1]:
            yield -1, '"'
            return
    yield -1, ""


def _ranges(batches: Iterable[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The ranges of a task with their texts; ``}`` is put back (after the end of a file it does no harm)."""

    def rows():
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "block", *more, "value")]
            for *key, value in zip(*columns, strict=True):
                yield tuple(key), value + "}"

    for key, texts in groupby(rows(), key=lambda r: r[0]):
        yield key, (t for _, t in texts)


def _array_start(texts: Iterator[str]) -> tuple[str, Iterator[str]] | None:
    """The text behind the bracket that opens the array, up to the next ``}``, and the texts after it."""
    head = ""
    for text in texts:
        head += text
        start = _BARE.match(head) or _WRAPPED.search(head)
        if start:
            return head[start.end() :], texts
    return None


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("found", pa.bool_()), ("ends", pa.list_(pa.bool_())), ("deltas", pa.list_(pa.int64())),
        ("lows", pa.list_(pa.int64())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64()))),
    ])
    for (path, block), texts in _ranges(batches):
        found, first = True, []
        if block == 0:
            start = _array_start(texts)
            found, (head, texts) = start is not None, start or ("", iter(()))
            first = [head]
        quoted, levels, lows, commas = [False, True], [0, 0], [0, 0], [Counter(), Counter()]
        for text in (t for part in (first, texts) for t in part):
            for case in (0, 1):
                level, low = levels[case], lows[case]
                for at, mark in _structure(text, 0, quoted[case]):
                    if at < 0:
                        quoted[case] = bool(mark)
                    elif mark == ",":
                        commas[case][level] += 1
                    elif mark in "[{":
                        level += 1
                    else:
                        level -= 1
                        low = min(low, level)
                levels[case], lows[case] = level, low
        row = [path, block, found, quoted, levels, lows, [list(c.items()) for c in commas]]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def _starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the summaries of a file, which come as one row: where each range begins, up to the one that ends the array."""
    for batch in batches:
        for path, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, quoted, level, idx = [], False, 1, 0
            for part in ranges:
                if not part["found"]:
                    break
                case = int(quoted)
                over = level + part["lows"][case] <= 0
                rows.append((path, part["block"], quoted, level, idx, over))
                if over:
                    break
                idx += dict(part["commas"][case]).get(1 - level, 0)
                quoted, level = part["ends"][case], level + part["deltas"][case]
            if rows:
                types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
                names = ["path", "block", "quoted", "level", "idx", "last"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _pieces(path: str, block: int, quoted: bool, level: int, idx: int, texts: Iterator[str]) -> Iterator[tuple]:
    """Elements, and parts of elements, of one range: ``path, idx, block, text, begins, ends``."""
    begins, held = block == 0, []
    if block == 0:
        start = _array_start(texts)
        if start is None:
            return
        first, texts = [start[0]], start[1]
    else:
        first = []
    for text in (t for part in (first, texts) for t in part):
        since = 0
        for at, mark in _structure(text, 0, quoted):
            if at < 0:
                quoted = bool(mark)
            elif mark in "[{":
                level += 1
            elif mark == "," and level == 1 or mark in "]}" and level == 1:
                held.append(text[since:at])
                yield path, idx, block, "".join(held), begins, mark != "}"  # a brace is no end of an array, nor is the one put behind the file
                if mark != ",":
                    return
                begins, held, since, idx = True, [], at + 1, idx + 1
            elif mark != ",":
                level -= 1
        held.append(text[since:])
    yield path, idx, block, "".join(held), begins, False


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["path", "idx", "block", "text", "begins", "ends"]
    for key, texts in _ranges(batches, "quoted", "level", "idx"):
        rows = []
        for row in _pieces(*key, texts):
            rows.append(row)
            if len(rows) >= _ROWS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for _ in texts:  # what follows the array's end
            pass


def array_elements(spark: SparkSession, glob: str, pattern: str, keep=None) -> DataFrame:
    """``path, idx, record, error``: every element of the JSON arrays in the files, bare or under ``articles`` of an object.

    ``keep`` may choose files by a condition on ``path`` (URL-encoded, as Spark gives it). A range is as large as
    ``spark.sql.files.maxPartitionBytes`` says. ``articles`` must begin in the first range. An element that is no JSON, or that the
    file's end breaks off, has an error, and so has a file without an array; elements behind a broken one are read as far as brackets
    and quotes still match. Empty arrays and empty files have no row.
    """
    path, block = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    texts = spark.read.option("lineSep", "}").option("pathGlobFilter", pattern).text(glob).select(path, block, "value")
    texts = texts if keep is None else texts.where(keep)
    summaries = texts.mapInArrow(_summaries, _SUMMARY)
    ranges = F.array_sort(F.collect_list(F.struct("block", "found", "ends", "deltas", "lows", F.transform("commas", F.map_entries).alias("commas"))))
    pairs = F.transform("ranges", lambda r: r.withField("commas", F.transform(r["commas"], lambda m: F.transform(m, lambda e: F.array(e["key"], e["value"])))))
    files = summaries.groupBy("path").agg(ranges.alias("ranges")).select("path", pairs.alias("ranges"))
    starts = files.mapInArrow(_starts, _START)
    # One row per range, so a millionth of the data and less: small beside any of its ranges.
    known = texts.join(F.broadcast(starts.drop("last")), ["path", "block"])
    parts = known.select("path", "block", "quoted", "level", "idx", "value").mapInArrow(_parts, _PART)
    whole = parts.where("begins and ends").select("path", "idx", "text", "ends")
    listed = F.array_sort(F.collect_list(F.struct("block", "text")))
    cut = parts.where("not (begins and ends)").groupBy("path", "idx").agg(F.array_join(listed["text"], "").alias("text"), F.bool_or("ends").alias("ends"))
    both = whole.union(cut.select("path", "idx", "text", "ends"))
    record = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = both.select("path", "idx", record.alias("record"), "ends").where("not (ends and idx = 0 and record = '')")
    readable = F.col("ends") & F.try_parse_json("record").isNotNull()
    rows = rows.select("path", "idx", F.when(readable, F.col("record")).alias("record"), F.when(~readable, F.lit("unreadable")).alias("error"))
    missing = files.where("not ranges[0].found").select("path", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("record"), F.lit("no array").alias("error"))
    return rows.union(missing)
