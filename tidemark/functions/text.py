"""Text cleaning, keyword matching and chunking as Column expressions.

Java's ``\\s`` and ``\\w`` are ASCII, so the classes are spelled out. They cover what Python's
Unicode ``\\s`` and ``\\w`` cover and mean the same in Spark and in DuckDB.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of a regex class, to be put between brackets.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"

# Every character that Python counts as whitespace.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The event vocabulary used when no other one is given.
EVENT_KEYWORDS = (
    "merger", "acquisition", "upgrade", "downgrade", "fork", "hack",
    "regulation", "ban", "lawsuit", "approval", "launch", "token", "ipo",
)

# The paywall notice cut out of article bodies.
PAYWALL_NOTICE = r"(?is)We are having trouble retrieving.*?Subscribe[" + SPACE + r"]*\."

# Chunk length and overlap, in tokens.
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 50

# Latin letters with a one-letter ASCII form, and those that need two letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿŠšŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyySsZz"
DIGRAPHS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}


def collapse(text: Column) -> Column:
    """Runs of whitespace to one blank, none at the edges."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip_edges(text: Column) -> Column:
    """Remove all whitespace at both ends; plain ``trim`` knows only the blank."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """Nothing but whitespace; looks no further than the first other character."""
    return ~text.rlike(f"[^{SPACE}]")


def drop_urls(text: Column, prefix: str = "http") -> Column:
    return F.regexp_replace(text, f"{prefix}[^{SPACE}]+", "")


def clean_social(text: Column) -> Column:
    """Comments: ASCII letters and digits only. NULL becomes the empty string."""
    kept = F.regexp_replace(drop_urls(F.coalesce(text, F.lit(""))), f"[^a-zA-Z0-9{SPACE}]+", "")
    return collapse(kept)


def clean_news(text: Column) -> Column:
    """News: Unicode letters, digits and underscore."""
    return collapse(F.regexp_replace(drop_urls(text), f"[^{WORD}{SPACE}]", ""))


def to_ascii(text: Column) -> Column:
    """Latin accents to plain letters. Other scripts stay as they are."""
    for letter, pair in DIGRAPHS.items():
        text = F.replace(text, F.lit(letter), F.lit(pair))
    return F.translate(text, ACCENTED, PLAIN)


def clean_forum(text: Column) -> Column:
    """Forum posts: as news, keeping ``, . ! ?``, after transliteration."""
    bare = drop_urls(to_ascii(text), "(?:http|www|https)")
    return collapse(F.regexp_replace(bare, f"[^{WORD}{SPACE},.!?]", ""))


def strip_tags(text: Column) -> Column:
    return strip_edges(F.regexp_replace(text, "<[^>]*>", ""))


def strip_paywall(text: Column) -> Column:
    return strip_edges(F.regexp_replace(text, PAYWALL_NOTICE, ""))


def keyword_list(words: Iterable[str]) -> tuple[str, ...]:
    """Usable event words of a vocabulary: alphabetic, longer than two letters, lower case."""
    return tuple(sorted({w.lower() for w in words if w.isalpha() and len(w) > 2}))


def keyword_pattern(words: Iterable[str]) -> str:
    """Whole-word, case-insensitive alternation; ``U`` makes ``\\b`` see accented letters."""
    return r"(?iU)\b(" + "|".join(re.escape(w) for w in words) + r")\b"


def event_flag(text: Column, words: Iterable[str] = EVENT_KEYWORDS) -> Column:
    """1 if any usable keyword occurs in the raw text, else 0; 0 for all texts without any."""
    words = keyword_list(words)
    if not words:
        return F.lit(0)
    return F.coalesce(text.rlike(keyword_pattern(words)).cast("int"), F.lit(0))


def event_hits(text: Column, words: Iterable[str] = EVENT_KEYWORDS) -> Column:
    """Distinct usable keywords that occur in the text."""
    words = keyword_list(words)
    if not words:
        return F.array().cast("array<string>")
    hits = F.regexp_extract_all(text, F.lit(keyword_pattern(words)), F.lit(1))
    return F.array_distinct(F.transform(hits, F.lower))


def article_text(*parts: Column) -> Column:
    """Parts joined by a blank; a NULL part is empty but keeps its blank."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" "), F.coalesce(part, F.lit(""))]
    return F.concat(*pieces[1:])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Inside a lambda a Column is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(clean: Column) -> Column:
    """Words of a cleaned text, which has single blanks and none at its edges; no words for an empty one. The text is computed once."""
    return F.array_remove(F.split(clean, " "), "")


def chunk_starts(size: Column, length: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """0-based first token of every chunk. Stops only when the start runs past the text."""
    step = length - overlap
    return F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def chunk_arrays(words: Column, length: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping token windows: ``array<array<string>>`` in text order."""
    return bind(
        words,
        lambda w: F.transform(
            chunk_starts(F.size(w), length, overlap), lambda s: F.slice(w, s + 1, F.lit(length))
        ),
    )


def weight_sum(words: Column, lexicon: Mapping[str, float]) -> Column:
    """Summed weight of the words; unknown words weigh nothing.

    The lexicon is one constant: entries in buckets by their checksum, so that a word is looked up in the few
    entries of its bucket, however many there are.
    """
    if not lexicon:
        return F.lit(0.0)
    size = 2 * len(lexicon)
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for entry, weight in sorted(lexicon.items()):
        buckets[zlib.crc32(entry.encode("utf-8")) % size].append({"w": entry, "x": float(weight)})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<w: string, x: double>>>")

    def weight(word: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(word.cast("binary")), F.lit(size)).cast("int"))
        return F.aggregate(bucket, F.lit(0.0), lambda s, e: s + F.when(e["w"] == word, e["x"]).otherwise(0.0))

    return F.aggregate(words, F.lit(0.0), lambda s, word: s + F.coalesce(weight(word), F.lit(0.0)))
