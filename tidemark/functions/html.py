"""HTML as Column expressions, for markup that does not nest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, strip_tags

INVISIBLE = "(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
PARAGRAPH = f"(?is)<p(?:[{SPACE}][^>]*)?>(.*?)</p>"


def flat_paragraphs(html: Column) -> Column:
    """Text of every paragraph; comments, scripts and styles are cut out first."""
    visible = F.regexp_replace(html, INVISIBLE, "")
    return F.transform(F.regexp_extract_all(visible, F.lit(PARAGRAPH), F.lit(1)), strip_tags)
