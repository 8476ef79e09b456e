"""Session settings, shared scratch space and small parameter tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MAX_PARAMETER_ROWS = 10_000
ROWS_OF_A_TASK = 500_000


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the session was started from.

    On a cluster it is sent to them as an archive; local workers find it through their path.
    """
    root = Path(__file__).resolve().parent
    if not spark.conf.get("spark.master", "").startswith("local"):
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark"), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
    elif str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), os.environ.get("PYTHONPATH", "")]))
        spark.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the folder named by ``spark.checkpoint.dir``, which all executors must see.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster it is an
    error, since a folder of the driver's machine would not do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that takes far longer than reading: a narrow table of millions of rows is one small file, so one task.

    Meant for rows that are narrow still, since they are shuffled; nothing else about them changes.
    """
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_evenly(rows: DataFrame, most: int = ROWS_OF_A_TASK) -> DataFrame:
    """The rows dealt over tasks of about ``most`` rows, for work whose memory grows with a task's rows: there are more tasks, not larger ones.

    Counts the rows first, which a columnar file answers from its metadata.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)))


def parameter_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A driver-side parameter list as a DataFrame; its size is checked, so it is safe to broadcast."""
    rows = [tuple(row) for row in rows]
    if len(rows) > MAX_PARAMETER_ROWS:
        raise ValueError(f"{len(rows)} parameter rows; pass a table instead of a list")
    return spark.createDataFrame(rows, schema)
