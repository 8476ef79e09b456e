"""Word pieces by longest match first, and chunks whose boundaries are counted in pieces.

A word is matched in one walk over a trie with failure links (as in Song et al., "Fast WordPiece Tokenization", 2021): where the
trie has no child for a character, the node knows which pieces are settled by then and from which node to go on, so
no character is read twice, however long the word or its near matches are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import CHUNK_OVERLAP, CHUNK_TOKENS

# The unknown token, the mark of pieces inside a word, and the longest word that is looked at.
UNKNOWN, INSIDE, LONGEST_WORD = "[UNK]", "##", 100
MAX_VOCABULARY = 1_000_000
CACHED_WORDS = 200_000

# The blocks of ideographs that stand as words of their own.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


class _Spaced(dict):
    """What becomes of a character before words are split: controls go, ideographs (and punctuation) stand alone."""

    def __init__(self, punctuation: bool):
        self.punctuation = punctuation

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)
        if self.punctuation:
            alone = kind[0] == "P" or (code < 128 and not char.isalnum() and 32 < code < 127)
            out = f" {char} " if alone else char
        elif char in "\t\n\r" or kind == "Zs":
            out = " "
        elif code in (0, 0xFFFD) or kind[0] == "C":
            out = ""
        else:
            out = f" {char} " if any(a <= code <= b for a, b in IDEOGRAPHS) else char
        self[code] = out
        return out


_CLEAN, _APART = _Spaced(False), _Spaced(True)
_MARKS = re.compile("[̀-\U0010ffff]")


def basic_words(text: str, lower: bool = True) -> list[str]:
    """Words and punctuation marks of a text; with ``lower`` without case and accents."""
    text = text.translate(_CLEAN)
    if lower and not text.isascii():
        text = unicodedata.normalize("NFD", text)
        if _MARKS.search(text):
            text = "".join([c for c in text if unicodedata.category(c) != "Mn"])
    return (text.lower() if lower else text).translate(_APART).split()


class Pieces:
    """The trie of a vocabulary: ``cut`` gives the pieces of a text, ``glue`` the text of pieces."""

    def __init__(self, vocabulary: Iterable[str], unknown: str = UNKNOWN, inside: str = INSIDE, longest: int = LONGEST_WORD, lower: bool = True):
        self.unknown, self.inside, self.longest, self.lower = unknown, inside, longest, lower
        self.children: list[dict[str, int]] = [{}, {}]  # node 0 starts a word, node 1 goes on inside it
        self.token: list[str | None] = [None, None]
        for token in vocabulary:
            if token:
                self._insert(0, token, token)
                if token.startswith(inside) and len(token) > len(inside):
                    self._insert(1, token[len(inside) :], token)
        self._link()
        self.known: dict[str, list[str]] = {}

    def _insert(self, node: int, path: str, token: str) -> None:
        for char in path:
            after = self.children[node].get(char)
            if after is None:
                after = self.children[node][char] = len(self.children)
                self.children.append({})
                self.token.append(None)
            node = after
        self.token[node] = token

    def _link(self) -> None:
        """For every node the pieces that are settled when it has no fitting child, and the node to go on from; -1: no pieces make it up."""
        self.next = [-1] * len(self.children)
        self.settled: list[list[str]] = [[] for _ in self.children]
        queue = deque((0, 1))
        while queue:
            node = queue.popleft()
            for char, child in self.children[node].items():
                queue.append(child)
                if self.token[child] is not None:
                    self.next[child], self.settled[child] = 1, [self.token[child]]
                    continue
                at, more = self.next[node], []
                while at >= 0 and char not in self.children[at]:
                    more += self.settled[at]
                    at = self.next[at]
                if at >= 0:
                    self.next[child], self.settled[child] = self.children[at][char], self.settled[node] + more

    def match(self, word: str) -> list[str]:
        """Pieces of one word: the longest token that starts it, then the longest that goes on, and so on; or the unknown token."""
        if len(word) > self.longest:
            return [self.unknown]
        node, out = 0, []
        for char in word:
            while (child := self.children[node].get(char)) is None:
                if self.next[node] < 0:
                    return [self.unknown]
                out += self.settled[node]
                node = self.next[node]
            node = child
        while node != 1:
            if self.next[node] < 0:
                return [self.unknown]
            out += self.settled[node]
            node = self.next[node]
        return out

    def cut(self, text: str) -> list[str]:
        out: list[str] = []
        for word in basic_words(text, self.lower):
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                found = self.known[word] = self.match(word)
            out += found
        return out

    def glue(self, pieces: list[str]) -> str:
        """The text of pieces; unknown words leave nothing, a piece inside a word keeps its mark only at the start."""
        return " ".join(p for p in pieces if p != self.unknown).replace(" " + self.inside, "")


def vocabulary_tokens(vocabulary: DataFrame, token: str = "token") -> list[str]:
    """The tokens of a table on the driver, sorted; their number is checked, so that they are safe to broadcast."""
    kept = vocabulary.where(F.col(token).isNotNull()).select(F.col(token).alias("token")).distinct().limit(MAX_VOCABULARY + 1)
    tokens = kept.agg(F.array_sort(F.collect_list("token")).alias("all")).first()["all"]
    if len(tokens) > MAX_VOCABULARY:
        raise ValueError(f"{len(tokens)} tokens or more; a vocabulary has at most {MAX_VOCABULARY}")
    return tokens


def wordpiece_chunks(
    texts: DataFrame, key: str, text: str, vocabulary: DataFrame, length: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, lower: bool = True
) -> DataFrame:
    """``key, chunk_no, n_pieces, chunk``: overlapping chunks of every text, counted in word pieces; the text of each chunk.

    ``vocabulary`` is a table with a column ``token``, at most a million rows. A chunk starts every ``length - overlap`` pieces while there are
    any left. NULL, empty and blank texts have no chunk. Texts stay in their rows and go out chunk by chunk, so nothing is shuffled. With
    ``Pieces`` itself, ``sentiment.model_scorer(load, cut=pieces.cut, glue=pieces.glue)`` scores the same chunks.
    """
    if not 0 <= overlap < length:
        raise ValueError(f"an overlap of {overlap} does not fit chunks of {length}")
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary_tokens(vocabulary))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = rows.select("key").schema.add("chunk_no", T.IntegerType()).add("n_pieces", T.IntegerType()).add("chunk", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value, lower=lower)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                of, numbers, sizes, chunks = [], [], [], []
                for row, value in enumerate(part.column(1).to_pylist()):
                    cut = pieces.cut(value or "")
                    for number, begin in enumerate(range(0, len(cut), length - overlap)):
                        chunk = cut[begin : begin + length]
                        of.append(row)
                        numbers.append(number)
                        sizes.append(len(chunk))
                        chunks.append(pieces.glue(chunk))
                arrays = [part.column(0).take(pa.array(of, pa.int32())), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(chunks, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "chunk_no", "n_pieces", "chunk"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
