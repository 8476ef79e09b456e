"""Readers of the landed files. Ticker, file and position come from the path and the scan itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.json_text import flat_json
from tidemark.operators.common import only_best
from tidemark.operators.news import search_docs, unify_articles
from tidemark.sources.json_split import array_elements


def folder_name() -> Column:
    """Folder a row was read from: the ticker, in the layouts ``BTC-USD/`` and ``Ticker=BTC-USD/``."""
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return F.url_decode(F.regexp_replace(folder, "^[^=]+=", ""))


def file_name() -> Column:
    return F.url_decode(F.col("_metadata.file_name"))


def header_names(header: Column) -> Column:
    """Names in a CSV header line; quotes around a name go, doubled ones inside become one."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), header), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), bare(c)).otherwise(c))


def csv_by_header(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows of CSV files as text, by the names in each file's own header; and all names that occur, sorted.

    Files may order or lack columns as they like: all are read once, by position, and a row's cells are looked up by the names of
    its file. The header lines cost a pass over the first block of every file; what comes to the driver is one row
    with the distinct names and the widest file. Of a name that a file repeats, the first column counts. Quotes are doubled inside
    quotes, which may hold line breaks, so a file is read by one task. ``file_path`` is the file of a row.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("n"), "value"
    )
    first = F.regexp_replace(F.min_by("value", "n"), "^\ufeff|\r$", "")
    heads = lines.groupBy("file_path").agg(header_names(first).alias("_names"))
    found = heads.agg(F.max(F.size("_names")).alias("width"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_names")))).alias("names")).first()
    if not found.width:
        return spark.createDataFrame([], "file_path string"), []
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(found.width)])
    reader = spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True)
    cells = reader.csv(path).select(F.array(*schema.names).alias("_cells"), F.col("_metadata.file_path").alias("file_path"))
    place = {n: F.array_position("_names", n).cast("int") - 1 for n in found.names}
    values = [F.when(at >= 0, F.get("_cells", at)).alias(n) for n, at in place.items()]
    return cells.join(heads, "file_path").select(*values, "file_path"), found.names


def _typed(rows: DataFrame, schema: str) -> list[Column]:
    """The columns of the schema by name; NULL where a file lacks one or a value can't be read."""

    def value(field: T.StructField) -> Column:
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType)
        cell = F.col(f"`{field.name}`")
        return F.try_to_date(cell) if isinstance(field.dataType, T.DateType) else cell.try_cast(field.dataType)

    return [value(f).alias(f.name) for f in T.StructType.fromDDL(schema).fields]


def folder_of(path: Column) -> Column:
    """Folder of a file, as :func:`folder_name` has it."""
    return F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^[^=]+=", ""))


def read_universe(spark: SparkSession, path: str, with_category: bool = True) -> DataFrame:
    """Assets by the names in the header; a column that a file lacks is NULL."""
    rows, _ = csv_by_header(spark, path)
    return rows.select(*_typed(rows, schemas.UNIVERSE if with_category else schemas.UNIVERSE_PLAIN))


def read_bars(spark: SparkSession, glob: str) -> DataFrame:
    """Bars of all tickers by the names in the header; the folder overrides the Ticker column of a file."""
    rows, _ = csv_by_header(spark, glob)
    return rows.select(*_typed(rows, schemas.BARS), "file_path").withColumn("Ticker", folder_of(F.col("file_path"))).drop("file_path")


def _whole_files(spark: SparkSession, glob: str, pattern: str) -> DataFrame:
    """One row per file, which must fit into a task; :func:`split_records` reads files of any size."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(glob)
    return text.select(folder_name().alias("Ticker"), file_name().alias("file"), "value")


def _elements(text: str) -> Iterator[tuple[int | None, str | None, str | None]]:
    """Position and text of each element of a JSON array, or of the array ``articles`` of an object.

    Where the text breaks off or is broken, what came before is kept and the last entry has the reason.
    """
    start = re.match(r"\s*\ufeff?\s*\[", text) or re.search(r'"articles"\s*:\s*\[', text)
    if start is None:
        yield None, None, "no array"
        return
    decoder, blank = json.JSONDecoder(), re.compile(r"\s*")
    at, idx = blank.match(text, start.end()).end(), 0
    if text[at : at + 1] == "]":
        return
    while True:
        try:
            _, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            yield idx, None, f"unreadable from character {at}"
            return
        yield idx, text[at:end], None
        idx, at = idx + 1, blank.match(text, end).end()
        mark = text[at : at + 1]
        if mark != ",":
            if mark != "]":
                yield idx, None, f"unreadable from character {at}"
            return
        at = blank.match(text, at + 1).end()


def json_records(files: DataFrame) -> DataFrame:
    """``Ticker, file, idx, record, error``: every element of every file, and a row with a reason for each broken file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["Ticker", "file", "idx", "record", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for ticker, file, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _elements(value or "")
                while rows := [(ticker, file, *e) for e in islice(found, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("Ticker", "file", "value").mapInArrow(cut, "Ticker string, file string, idx long, record string, error string")


def split_records(spark: SparkSession, glob: str, pattern: str, keep: Column | None = None) -> DataFrame:
    """The columns of :func:`json_records`, from files that are read in ranges: a file of any size is the work of many tasks."""
    rows = array_elements(spark, glob, pattern, keep)
    file = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return rows.select(folder_of(F.col("path")).alias("Ticker"), file.alias("file"), "idx", "record", "error")


def _comment_records(spark: SparkSession, folders: str, raw: bool, pattern: str) -> DataFrame:
    merged = F.element_at(F.split("path", "/"), -1).contains("_merge_")
    schema = f"struct<{schemas.RAW_COMMENT if raw else schemas.COMMENT}, _corrupt_record: string>"
    parsed = F.from_json("record", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = split_records(spark, folders, pattern, ~merged).withColumn("c", parsed)
    broken = F.when(F.col("c._corrupt_record").isNotNull() | F.col("c").isNull(), "not a comment")
    return rows.withColumn("error", F.coalesce("error", broken))


def read_comments(spark: SparkSession, folders: str, raw: bool = False, pattern: str = "*_comments.json") -> DataFrame:
    """Comments of every matching file but the merged ones, with file name and array position.

    What can't be read is in :func:`unreadable_comments`.
    """
    rows = _comment_records(spark, folders, raw, pattern).where("error is null")
    return rows.select("Ticker", "file", "idx", "c.*").drop("_corrupt_record")


def unreadable_comments(spark: SparkSession, folders: str, raw: bool = False, pattern: str = "*_comments.json") -> DataFrame:
    """``Ticker, file, idx, record, error`` of what :func:`read_comments` leaves out; a broken file has one row."""
    return _comment_records(spark, folders, raw, pattern).where("error is not null").drop("c")


def read_comment_lines(spark: SparkSession, path: str) -> DataFrame:
    """Comments as the library writes them: JSON lines in a folder per ticker, with file and position."""
    return spark.read.schema(f"Ticker string, file string, idx bigint, {schemas.COMMENT}").json(path)


def _day_records(spark: SparkSession, folders: str, pattern: str) -> DataFrame:
    rows = split_records(spark, folders, pattern)
    # Names are told apart by case; files have either.
    text = F.coalesce(F.get_json_object("record", "$.Date"), F.get_json_object("record", "$.date"))
    comments = F.from_json(F.get_json_object("record", "$.comments"), f"array<struct<{schemas.COMMENT}>>")
    rows = rows.withColumn("Date", F.try_to_date(text, "yyyy-MM-dd")).withColumn("comments", comments)
    broken = F.when(F.col("Date").isNull(), "no day").when(F.col("comments").isNull(), "no comments")
    return rows.withColumn("error", F.coalesce("error", broken))


def read_comment_days(spark: SparkSession, folders: str, pattern: str = "*_merge_comments.json") -> DataFrame:
    """Merged comments: Ticker, Date and the comments of the day. The rest is in :func:`unreadable_days`."""
    return _day_records(spark, folders, pattern).where("error is null").select("Ticker", "Date", "comments")


def unreadable_days(spark: SparkSession, folders: str, pattern: str = "*_merge_comments.json") -> DataFrame:
    """``Ticker, file, idx, record, error`` of the days that :func:`read_comment_days` leaves out."""
    return _day_records(spark, folders, pattern).where("error is not null").select("Ticker", "file", "idx", "record", "error")


def _article_records(spark: SparkSession, folders: str, pattern: str) -> DataFrame:
    rows = split_records(spark, folders, pattern).withColumn("Ticker", ticker_of_news_file(F.col("file")))
    broken = F.when(~F.coalesce(F.schema_of_variant(F.try_parse_json("record")).startswith("OBJECT"), F.lit(False)), "not an article")
    return rows.withColumn("error", F.coalesce("error", broken))


def read_articles(spark: SparkSession, folders: str, pattern: str = "*_news.json") -> DataFrame:
    """Articles of news files, a bare list or an object with ``articles``; the ticker is in the file name."""
    rows = _article_records(spark, folders, pattern).where("error is null")
    return common_articles(rows.select("Ticker", F.col("record").alias("raw")))


def unreadable_articles(spark: SparkSession, folders: str, pattern: str = "*_news.json") -> DataFrame:
    """``Ticker, file, idx, record, error`` of what :func:`read_articles` leaves out."""
    return _article_records(spark, folders, pattern).where("error is not null")


def ticker_of_news_file(file: Column) -> Column:
    return F.replace(F.regexp_extract(file, r"([^/]+)\.json$", 1), F.lit("_news"), F.lit(""))


def parse_articles(feeds: DataFrame, column: str) -> DataFrame:
    """Articles of JSON feeds in the common layout. Field names are told apart by case."""
    bare = F.ltrim(column).startswith("[")
    listed = F.when(bare, F.from_json(column, "array<string>")).otherwise(
        F.from_json(column, "struct<articles: array<string>>")["articles"]
    )
    return common_articles(feeds.select("Ticker", F.explode(listed).alias("raw")))


def common_articles(items: DataFrame) -> DataFrame:
    """Single articles (``Ticker``, ``raw`` JSON) in the common layout."""
    fields = items.select("Ticker", F.parse_json("raw").alias("v"))

    def first_of(*names: str) -> Column:
        values = [F.variant_get("v", f"$.{n}", "variant") for n in names]
        filled = [F.when(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")) != "", v) for v in values]
        return F.coalesce(*filled)

    return unify_articles(
        fields.select(
            "Ticker",
            F.try_variant_get(first_of("Date", "date", "published_date"), "$", "string").alias("Date"),
            flat_json(first_of("Title", "headline")).alias("Title"),
            flat_json(first_of("Summary", "abstract")).alias("Summary"),
            flat_json(first_of("Body", "body")).alias("Body"),
        )
    )


def parse_search_pages(pages: DataFrame, column: str) -> DataFrame:
    """Hits of landed search pages, one row each, with the position on the page."""
    keep = [c for c in pages.columns if c != column]
    parsed = pages.select(*keep, F.from_json(column, schemas.SEARCH_PAGE)["response"]["docs"].alias("docs"))
    return search_docs(parsed)


def parse_observations(responses: DataFrame, column: str) -> DataFrame:
    """Date and raw value of every observation of landed series."""
    keep = [c for c in responses.columns if c != column]
    listed = F.from_json(column, schemas.OBSERVATIONS)["observations"]
    return responses.select(*keep, F.inline(listed))


def preferred_files(rows: DataFrame, folder: str, file: str, suffix: str) -> DataFrame:
    """Rows of ``<folder><suffix>``; rows of other files only for folders without it."""
    other = (F.col(file) != F.concat(F.col(folder), F.lit(suffix))).cast("int")
    return only_best(rows, [folder], other)


def read_categories(spark: SparkSession, glob: str) -> DataFrame:
    """Category rows of all tickers by the names in the header, from the preferred file of a folder or else from all its files.

    A column that a file lacks is NULL; an unknown column is an error that names it.
    """
    raw, names = csv_by_header(spark, glob)
    if extra := sorted(set(names) - set(schemas.CATEGORY_COLUMNS)):
        raise ValueError(f"categories: unexpected columns {extra}")
    file = F.url_decode(F.element_at(F.split("file_path", "/"), -1))
    rows = raw.select(*_typed(raw, schemas.CATEGORIES), folder_of(F.col("file_path")).alias("folder"), file.alias("file"))
    return preferred_files(rows, "folder", "file", "_categories.csv").drop("folder", "file")
