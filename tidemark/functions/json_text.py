"""Nested JSON values as plain text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(value) -> list[str]:
    """Texts of all scalars inside, in order; an empty list or object counts as one empty text."""
    found, waiting = [], [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, (list, dict)) and item:
            waiting += reversed(list(item.values() if isinstance(item, dict) else item))
        elif isinstance(item, bool):
            found.append("true" if item else "false")
        else:
            found.append(item if isinstance(item, str) else "")
    return found


@F.pandas_udf(T.StringType())
def _flat(texts: pd.Series) -> pd.Series:
    # Numbers keep the spelling they have.
    read = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str).decode
    return texts.map(lambda text: None if text is None else " ".join(leaves(read(text))))


def flat_json(value: Column) -> Column:
    """Scalars as text, lists and objects as their values joined by a blank at any depth, NULL as ''.

    Works on a VARIANT, whose objects are ordered by key; so their values come in the order of their keys.
    Scalars stay in the JVM.
    """
    kind = F.schema_of_variant(value)
    nested = F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))
    scalar = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    return F.when(nested, _flat(F.when(nested, F.to_json(value)))).otherwise(scalar)
