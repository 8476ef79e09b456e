"""Helpers shared by the operators: cutting lineage in shared space, free column names, text slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import shared_dir


def cut(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``; Spark deletes the files once nothing refers to them."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession, "checkpoints"))
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in shared space, so that later readers take only the columns they need."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores put in front until no column has it (Spark ignores case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task makes from a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
