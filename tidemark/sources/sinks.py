"""Writers. Partitioned by ticker where readers want one; never over the path that is being read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.common import require_columns
from tidemark.schemas import CATEGORY_COLUMNS, NEWS_URL_COLUMNS


def write_by_ticker(frame: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per ticker. Rebalancing by ticker gives a small ticker one file, while adaptive
    execution splits a large one over many tasks."""
    writer = frame.hint("rebalance", "Ticker").write.mode(mode).partitionBy("Ticker")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_json_lines(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested rows as JSON lines, which later readers can split."""
    if "Ticker" in frame.columns:
        write_by_ticker(frame, path, "json", mode)
    else:
        frame.write.mode(mode).json(path)


def write_fixed_csv(frame: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """CSV with a header and exactly these columns in this order."""
    require_columns(frame, columns, path)
    frame.select(*(F.col(f"`{c}`") for c in columns)).write.mode(mode).option("header", True).csv(path)


def write_categories(frame: DataFrame, path: str) -> None:
    write_fixed_csv(frame, path, CATEGORY_COLUMNS)


def write_news_urls(frame: DataFrame, path: str) -> None:
    write_fixed_csv(frame, path, NEWS_URL_COLUMNS)


def write_macro(table: DataFrame, path: str) -> None:
    """Macro table with every number in four decimals."""
    numbers = [n for n, kind in table.dtypes if kind == "double"]
    # format_string(NULL) would print "null".
    four = {n: F.when(F.col(n).isNotNull(), F.format_string("%.4f", F.col(n))) for n in numbers}
    write_fixed_csv(table.withColumns(four), path, table.columns)


def write_records(records: DataFrame, path: str) -> None:
    """Header-to-cell maps, one JSON object per line."""
    records.select(F.to_json("record").alias("value")).write.text(path)


# -- versions of the master -------------------------------------------------------------------


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the complete versions under ``base``; a version counts once its success marker is there."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and done(n))


def read_master(spark: SparkSession, base: str) -> DataFrame:
    """The latest complete version."""
    versions = _versions(spark, base)
    if not versions:
        raise FileNotFoundError(f"no master under {base}")
    return spark.read.parquet(f"{base}/v{versions[-1]}")


def publish_master(master: DataFrame, base: str) -> str:
    """Write the master as a new version; readers move on when it is complete.

    The version a refresh reads stays as it is, so a job that dies half-way leaves nothing broken.
    """
    versions = _versions(master.sparkSession, base)
    path = f"{base}/v{(versions[-1] if versions else 0) + 1}"
    write_by_ticker(master, path, mode="overwrite")
    return path
