"""Fused feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuse(frame: DataFrame, blocks: Mapping[str, Sequence[str]], name: str = "x", known: Mapping[str, str] | None = None) -> DataFrame:
    """One numeric vector per row, the blocks in the given order; missing values are 0.

    Also adds ``has_<block>``, so that a true 0 can be told from an absent modality; ``known`` names the column that
    tells it for blocks whose gaps are filled already.
    """
    known = known or {}
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for cs in blocks.values() for c in cs]
    present = {
        f"has_{block}": F.col(known[block])
        if block in known
        else F.coalesce(*(F.col(c).cast("double") for c in cs)).isNotNull().cast("int")
        for block, cs in blocks.items()
    }
    return frame.withColumn(name, F.array(*columns)).withColumns(present)
