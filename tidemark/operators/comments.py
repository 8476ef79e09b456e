"""Comments: one schema for all sources, dedupe, nesting by day and unnesting to snippets."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.dates import epoch_day_text, strict_day
from tidemark.functions.text import clean_forum, is_blank, strip_edges, strip_tags
from tidemark.operators.common import keep_first
from tidemark.schemas import REPLY

# Fixed value: newest submissions taken per ticker and forum.
NEWEST_PER_FORUM = 50


# -- one schema -------------------------------------------------------------------------------


def project_comment(raw: DataFrame) -> DataFrame:
    """Crawled comments with defaults for missing fields, tags stripped and the day as text."""
    zero = lambda path: F.coalesce(F.col(path), F.lit(0)).cast("bigint")
    texts = F.transform("content", lambda c: F.struct(strip_tags(F.coalesce(c["text"], F.lit(""))).alias("text")))
    own = {
        "time": epoch_day_text(F.col("time")),
        "replies_count": zero("replies_count"),
        "rank": F.struct(
            *(zero(f"rank.{f}").alias(f) for f in ("ranks_up", "ranks_down", "ranked_by_current_user"))
        ),
        "replies": F.coalesce("replies", F.array().cast("array<string>")),
        "content": F.coalesce(texts, F.array().cast("array<struct<text:string>>")),
        "best_score": zero("best_score"),
        "total_replies_count": zero("total_replies_count"),
        "user_reputation": zero("user_reputation"),
        "additional_data": F.coalesce("additional_data", F.lit("{}")),
    }
    keep = [c for c in raw.columns if c in ("Ticker", "file", "idx", "written_at")]
    return raw.select(*keep, *(c.alias(n) for n, c in own.items()))


def forum_comment(submissions: DataFrame) -> DataFrame:
    """Forum submissions in the comment schema: the title is the text, the score is the best score.

    Replies that are empty after cleaning are left out and not counted. The feed's constant label
    is not carried over.
    """
    cleaned = F.filter(F.transform("replies", clean_forum), lambda t: t != "")
    replies = F.transform(cleaned, lambda t: F.to_json(F.struct(t.alias("text"))))
    count = F.size(cleaned).cast("bigint")
    return submissions.select(
        *[c for c in ("Ticker", "file", "idx") if c in submissions.columns],
        epoch_day_text(F.col("created")).alias("time"),
        count.alias("replies_count"),
        F.struct(
            F.col("ups").alias("ranks_up"),
            F.col("downs").alias("ranks_down"),
            F.col("score").alias("ranked_by_current_user"),
        ).alias("rank"),
        replies.alias("replies"),
        F.array(F.struct(clean_forum(F.col("title")).alias("text"))).alias("content"),
        F.col("score").alias("best_score"),
        count.alias("total_replies_count"),
        F.coalesce("karma", F.lit(0)).cast("bigint").alias("user_reputation"),
    )


def within_range(frame: DataFrame, stamp: str, start: str, end: str, whole_end_day: bool = False) -> DataFrame:
    """Rows from ``start`` to ``end``. The end is its midnight unless ``whole_end_day``."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if whole_end_day:
        return frame.where((F.col(stamp) >= first) & (F.col(stamp) < F.lit(end).cast("date") + 1))
    return frame.where(F.col(stamp).between(first, last))


def newest_per_group(frame: DataFrame, groups: Sequence[str], newest_first: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows of every group; each map task passes on at most ``n`` rows per group."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*newest_first))
    return frame.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def time_coverage(frame: DataFrame, groups: Sequence[str], stamp: str) -> DataFrame:
    return frame.groupBy(*groups).agg(
        F.min(stamp).alias("oldest"), F.max(stamp).alias("newest"), F.count("*").alias("comments")
    )


# -- union, dedupe, nesting -------------------------------------------------------------------


def representative_text(columns: Sequence[str]) -> Column:
    """Text of the first content item, or the plain text field where there is no content."""
    plain = F.col("text") if "text" in columns else F.lit(None).cast("string")
    first = F.when(F.size("content") > 0, F.get("content", F.lit(0))["text"]).otherwise(plain)
    return F.coalesce(first, F.lit(""))


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Comments of all sources: the day is ``time``, else ``Date``; the source name is dropped."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    days = [F.col(c) for c in ("time", "Date") if c in rows.columns]
    return rows.withColumn("Date", F.coalesce(*days)).drop("time", "source")


def merge_comments(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of the sources, first copy of each text per ticker and day.

    First means file name, then position in the file (``file``, ``idx``). Undated and empty
    comments are left out.
    """
    rows = union_sources(sources)
    text = representative_text(rows.columns)
    rows = rows.where(F.col("Date").isNotNull() & (F.col("Date") != "") & ~is_blank(text))
    # The digest keeps long texts out of the sort keys.
    rows = rows.withColumn("_digest", F.sha2(strip_edges(text), 256))
    kept = keep_first(rows, ["Ticker", "Date", "_digest"], ["file", "idx"])
    return kept.withColumn("Date", strict_day(F.col("Date"))).drop("_digest")


def nest_by_day(comments: DataFrame, block: int = 1000) -> DataFrame:
    """Comments as arrays in source order: one row per ticker, day, file and block of positions.

    A block holds at most ``block`` comments, so that no busy day ends up in one row. The rows of
    a day, ordered by file and block, are the whole day.
    """
    payload = [c for c in comments.columns if c not in ("Ticker", "Date", "file", "idx")]
    part = F.floor(F.col("idx") / block).cast("bigint")
    ordered = F.sort_array(F.collect_list(F.struct("idx", *payload)))
    return (
        comments.withColumn("block", part)
        .groupBy("Ticker", "Date", "file", "block")
        .agg(ordered.alias("comments"))
    )


def newest_days_first(days: DataFrame) -> DataFrame:
    return days.orderBy(F.col("Date").desc(), "Ticker", "file", "block")


# -- snippets ---------------------------------------------------------------------------------


def reply_texts(reply: Column) -> Column:
    """Texts of one reply: an object with ``content``, an object with ``text``, or a plain string.

    Replies come as raw JSON: objects start with a brace, strings are bare.
    """
    parsed = F.from_json(reply, REPLY)
    listed = F.transform(parsed["content"], lambda c: c["text"])
    is_object = F.ltrim(reply).startswith("{") & parsed["_corrupt_record"].isNull()
    return (
        F.when(is_object & parsed["content"].isNotNull(), listed)
        .when(is_object, F.array(parsed["text"]))
        .otherwise(F.array(reply))
    )


def comment_snippets(comments: DataFrame, source: str = "Merged") -> DataFrame:
    """One row per text of a comment and of its direct replies. Empty texts are dropped, blank ones kept."""
    main = F.transform("content", lambda c: F.struct(c["text"].alias("Text"), F.lit("Main").alias("Type")))
    replies = F.transform(
        F.flatten(F.transform("replies", reply_texts)),
        lambda t: F.struct(t.alias("Text"), F.lit("Reply").alias("Type")),
    )
    none = F.array().cast("array<struct<Text:string,Type:string>>")
    both = F.concat(F.coalesce(main, none), F.coalesce(replies, none))
    rows = comments.select("Ticker", "Date", F.inline(both))
    return rows.where(F.length("Text") > 0).withColumn("Source", F.lit(source))


def unnest_days(days: DataFrame) -> DataFrame:
    """Comments of day-nested rows, under the date of their day."""
    each = days.select("Ticker", "Date", F.explode("comments").alias("c"))
    own = [f for f in each.schema["c"].dataType.fieldNames() if f not in ("Ticker", "Date", "time")]
    return each.select("Ticker", "Date", *(F.col(f"c.{f}") for f in own))


# -- reply trees ------------------------------------------------------------------------------

NODES = "path string, depth int, text string, error string"


def reply_nodes(comment: str | None) -> Iterator[tuple[str, int, str | None, str | None]]:
    """Path, depth and text of every node of a comment tree, in order, or the reason why a node has none.

    A node is an object with ``content`` (a text per entry) or ``text`` or both, or a plain string, and an object
    may have ``replies``; this holds at every depth. NULL has no nodes.
    """
    if comment is None:
        return
    try:
        waiting = [("0", 0, json.loads(comment))]
    except (ValueError, RecursionError):
        yield "0", 0, None, "unreadable"
        return
    while waiting:
        path, depth, node = waiting.pop()
        if isinstance(node, str):
            yield path, depth, node, None
            continue
        if not isinstance(node, dict):
            yield path, depth, None, "neither object nor text"
            continue
        content, replies = node.get("content") or [], node.get("replies") or []
        if not isinstance(content, list) or not isinstance(replies, list):
            yield path, depth, None, "content or replies are no list"
            continue
        texts = [c.get("text") if isinstance(c, dict) else c for c in content]
        texts += [node["text"]] if isinstance(node.get("text"), str) else []
        for text in texts:
            yield path, depth, text if isinstance(text, str) else "", None
        waiting += [(f"{path}.{i}", depth + 1, r) for i, r in reversed(list(enumerate(replies)))]


def _all_nodes(roots: DataFrame, key: str, comment: str) -> DataFrame:
    schema = StructType([roots.schema[key], *StructType.fromDDL(NODES).fields])
    layout = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = ((k, *n) for k, c in zip(*(x.to_pylist() for x in batch.columns)) for n in reply_nodes(c))
            while rows := list(islice(nodes, 5000)):
                columns = [pa.array(v, f.type) for v, f in zip(zip(*rows), layout)]
                yield pa.RecordBatch.from_arrays(columns, schema=layout)

    return roots.select(key, comment).mapInArrow(walk, schema)


def flatten_replies(roots: DataFrame, key: str, comment: str) -> DataFrame:
    """All texts of a comment tree (raw JSON), tags stripped, with the position path and depth of their node.

    A tree is parsed once, whatever its depth. What is no node is in :func:`unreadable_replies`.
    """
    nodes = _all_nodes(roots, key, comment).where("error is null")
    return nodes.select(key, "path", "depth", strip_tags(F.col("text")).alias("text"))


def unreadable_replies(roots: DataFrame, key: str, comment: str) -> DataFrame:
    """Key, path, depth and reason of everything in the trees that :func:`flatten_replies` leaves out."""
    return _all_nodes(roots, key, comment).where("error is not null").drop("text")
