"""BPE over word pieces as a streaming transducer with bounded lookahead, and the way back.

A merge can reach back only so far: whether two tokens merge depends on what lies to their right through
a chain of merges of falling rank, and the longest such chain of the merge list is its sufficient
lookahead. The transducer holds that many symbols back and emits what can't change any more, so a word of
any length needs constant memory. Decoding is a state machine over ids, with the bytes of an unfinished
character as its state.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm.common import sliced

CACHED_WORDS = 300_000
LONG_WORD = 48  # bytes; longer words go through the transducer by parts, and are not kept
NEVER = 1 << 60
IDS_AT_ONCE = 1 << 16

# The word pattern of the files that load() takes, and the same over letters below U+0250, whose classes have
# not changed in any version of Unicode (no marks, and these numbers only).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\w\s]|_)+")
_NOT_LATIN = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for number, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(0x100 + number)
    return [letters[b] for b in range(256)]


def load(path: str) -> dict:
    """What the transducer needs of a tokenizer file, in plain and small values: fit for a broadcast.

    The file must be a byte-level BPE with NFC, white space and lower-case normalisation, as the
    word vocabularies of this kind are; anything else is an error.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or split["pattern"]["Regex"] != PATTERN or level["type"] != "ByteLevel" or spec["decoder"]:
        raise ValueError(f"{path}: not a word-level BPE file")
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    letters = byte_letters()
    merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["merges"]]
    return {
        "tokens": {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]},
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "merges": merges,
        "inside": [vocabulary[c] for c in letters],
        "last": [vocabulary[c + suffix] for c in letters],
        "suffix": suffix,
        "lookahead": sufficient_lookahead(merges),
    }


def sufficient_lookahead(merges: list[tuple[int, int, int]]) -> int:
    """Symbols right of a boundary that can decide about it; ``merges`` are ``(left, right, product)`` by rank.

    A merge fails only if its right part is disturbed: something at the right end of that part merges
    across its edge earlier. That merge has a lower rank and the same condition, so the reach of a merge is the
    length of its right part plus the largest reach among those it can be disturbed by.
    """
    length: dict[int, int] = {}
    made: dict[int, list[tuple[int, int]]] = {}  # product: ranks and right parts
    ranks: dict[int, list[int]] = {}  # left part: ranks, rising
    most: dict[int, list[int]] = {}  # and the largest reach up to each
    longest = 0
    for rank, (left, right, product) in enumerate(merges):
        length[product] = length.get(left, 1) + length.get(right, 1)
        beyond, ends, seen = 0, [(right, rank)], set()
        while ends:
            token, until = ends.pop()
            at = bisect_left(ranks.get(token, ()), until)
            if at:
                beyond = max(beyond, most[token][at - 1])
            for born, last in made.get(token, ()):
                if born < until and (last, born) not in seen:
                    seen.add((last, born))
                    ends.append((last, born))
        reach = length.get(right, 1) + beyond
        made.setdefault(product, []).append((rank, right))
        ranks.setdefault(left, []).append(rank)
        before = most.setdefault(left, [])
        before.append(max(reach, before[-1] if before else 0))
        longest = max(longest, reach)
    return longest


class Merger:
    """Applies the merges to a list of symbols, lowest rank first, from the left."""

    def __init__(self, spec: dict):
        self.rank = {left << 32 | right: rank for rank, (left, right, _) in enumerate(spec["merges"])}
        self.product = [product for _, _, product in spec["merges"]]

    def __call__(self, symbols: list[int]) -> list[int]:
        rank_of = self.rank.get
        while len(symbols) > 1:
            ranks = [rank_of(a << 32 | b, NEVER) for a, b in zip(symbols, symbols[1:])]
            lowest = min(ranks)
            if lowest == NEVER:
                break
            product, at, start, merged = self.product[lowest], ranks.index(lowest), 0, []
            while at >= 0:
                merged += symbols[start:at]
                merged.append(product)
                start = at + 2
                try:
                    at = ranks.index(lowest, start)
                except ValueError:
                    at = -1
            symbols = merged + symbols[start:]
        return symbols


class Transducer:
    """Symbols of one word go in by parts, tokens come out as soon as nothing to come can change them."""

    def __init__(self, merge: Merger, lengths: dict[int, int], lookahead: int):
        self.merge, self.lengths, self.lookahead = merge, lengths, lookahead
        self.held: list[int] = []

    def feed(self, symbols: list[int]) -> list[int]:
        """Takes symbols none of which is the word's last."""
        self.held += symbols
        stable, out, end = len(self.held) - self.lookahead, [], 0
        if stable > 0:
            for token in self.merge(self.held):
                if end + self.lengths.get(token, 1) >= stable:
                    break
                end += self.lengths.get(token, 1)
                out.append(token)
            self.held = self.held[end:]
        return out

    def finish(self, last: list[int]) -> list[int]:
        out, self.held = self.merge(self.held + last), []
        return out


class WordMerger:
    """Applies the merges to many whole words at once: in each step every word merges its first pair of lowest rank."""

    def __init__(self, spec: dict):
        keys = np.array([left << 32 | right for left, right, _ in spec["merges"]], np.int64)
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, NEVER)
        self.product = np.array([product for _, _, product in spec["merges"]], np.int64)
        self.inside, self.last = (np.array(spec[k], np.int64) for k in ("inside", "last"))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[at] == pairs, self.order[at], NEVER)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (of a byte or more), as little-endian 32-bit integers."""
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, of = self.inside[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        ranks = np.full(len(symbols), NEVER)
        inner = np.flatnonzero(of[:-1] == of[1:])
        ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            wide = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            ready = wide == NEVER
            if ready.any():
                done.append((of[ready], symbols[ready]))
                symbols, of, ranks, wide = (x[~ready] for x in (symbols, of, ranks, wide))
            at = np.flatnonzero(ranks == wide)
            if not len(at):
                continue
            at = at[np.append(True, of[at][1:] != of[at][:-1])]
            symbols[at] = self.product[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, of, ranks = symbols[stay], of[stay], ranks[stay]
            at = at - np.arange(len(at))
            for near in (at, at[at > 0] - 1):
                joined = near[near + 1 < len(symbols)]
                joined = joined[of[joined] == of[joined + 1]]
                ranks[near] = np.where(of[near] == of[np.minimum(near + 1, len(of) - 1)], ranks[near], NEVER)
                ranks[joined] = self._ranks(symbols[joined], symbols[joined + 1])
            ranks[-1] = NEVER
        of, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        packed = symbols[order].astype("<u4").tobytes()
        cuts = np.append(0, np.cumsum(np.bincount(of, minlength=len(words)))).tolist()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Ids of texts, as little-endian 32-bit integers."""

    def __init__(self, spec: dict):
        self.spec, self.merge, self.merge_words = spec, Merger(spec), WordMerger(spec)
        self.lengths: dict[int, int] = {}
        for left, right, product in spec["merges"]:
            self.lengths[product] = self.lengths.get(left, 1) + self.lengths.get(right, 1)
        # Beyond Latin, character classes follow the Unicode tables of the library that the ids are meant for.
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(spec["added"], key=len, reverse=True))) + ")") if spec["added"] else None
        self.added_ids = {text: np.array([i], "<u4").tobytes() for text, i in spec["added"].items()}
        self.block = 4 * spec["lookahead"] + 64
        self.known: dict[str, bytes] = {}

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one word, from its bytes, in parts."""
        inside, word = self.spec["inside"], Transducer(self.merge, self.lengths, self.spec["lookahead"])
        start = 0
        while len(data) - start > self.block:
            yield word.feed([inside[b] for b in data[start : start + self.block]])
            start += self.block
        yield word.finish([inside[b] for b in data[start:-1]] + [self.spec["last"][data[-1]]])

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without added tokens."""
        if not _NOT_LATIN.search(text):
            return _LATIN_WORDS.findall(unicodedata.normalize("NFC", text).lower() if not text.isascii() else text.lower())
        found = []
        for piece in _SPACE.split(text):
            found += [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(piece))] if piece else []
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none. Strings of added tokens are found before anything else.

        Words of ordinary length are merged for all texts together and remembered (a bounded number).
        """
        parts = [self.added.split(t or "") if self.added else [t or ""] for t in texts]
        cut = [[self.words(p) if i % 2 == 0 else p for i, p in enumerate(row)] for row in parts]
        wanted = set().union(*(words for row in cut for words in row[::2]))
        if len(self.known) + len(wanted) > CACHED_WORDS:
            self.known = {}
        new = {w: w.encode("utf-8") for w in wanted.difference(self.known)}
        short = [w for w, data in new.items() if len(data) <= LONG_WORD]
        if short:
            self.known.update(zip(short, self.merge_words([new[w] for w in short]), strict=True))
        long = {
            w: b"".join(np.array(part, "<u4").tobytes() for part in self.stream(data))
            for w, data in new.items() if len(data) > LONG_WORD
        }
        table = {**self.known, **long} if long else self.known
        return [
            b"".join(b"".join(map(table.__getitem__, x)) if i % 2 == 0 else self.added_ids[x] for i, x in enumerate(row))
            for row in cut
        ]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Ids go in by parts, text comes out.

    Without ``as_bytes`` the text is what a vocabulary file without decoder stands for: the tokens as they are
    written, a space between two. With it, tokens are bytes: a character is written once its last byte
    is there, the end of a word is a space, and bytes that form no character become U+FFFD.
    """

    def __init__(self, spec: dict, as_bytes: bool = False):
        self.as_bytes, self.started = as_bytes, False
        if not as_bytes:
            self.tokens = [spec["tokens"].get(i, "") for i in range(max(spec["tokens"]) + 1)]
            return
        value = {letter: b for b, letter in enumerate(byte_letters())}
        ends, added = spec["suffix"], set(spec["added"].values())
        self.tokens = {}
        for i, token in spec["tokens"].items():
            if i in added:
                self.tokens[i] = token.encode("utf-8")
                continue
            closed = bool(ends) and token.endswith(ends)
            self.tokens[i] = bytes(value[c] for c in (token[: -len(ends)] if closed else token)) + b" " * closed
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.as_bytes:
            return self.text.decode(b"".join(map(self.tokens.__getitem__, ids)))
        tokens = self.tokens
        joined = " ".join([tokens[i] for i in ids])
        glue = " " if self.started and joined else ""
        self.started |= bool(joined)
        return glue + joined

    def fresh(self) -> Decoder:
        """The machine in its first state."""
        self.started = False
        if self.as_bytes:
            self.text.reset()
        return self

    def finish(self) -> str:
        return self.text.decode(b"", True) if self.as_bytes else ""


def decoded_digest(machine: Decoder, ids: bytes) -> str:
    """SHA-256 of the text that a new machine decodes; the text is never held whole."""
    digest = hashlib.sha256()
    numbers = np.frombuffer(ids, "<u4")
    for start in range(0, len(numbers), IDS_AT_ONCE):
        digest.update(machine.feed(numbers[start : start + IDS_AT_ONCE].tolist()).encode("utf-8"))
    digest.update(machine.finish().encode("utf-8"))
    return digest.hexdigest()


def tokenized(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and with ``with_ids`` the ``ids``.

    ``path`` is the vocabulary file, read by the driver and broadcast (its size is that of the
    vocabulary). Null texts count as empty; rows are treated one by one, so repeated rows give repeated
    results and a null ``doc_id`` stays null. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(path))
    more = ", ids array<int>" if with_ids else ""

    def run(batches):
        spec = shared.value
        encoder, decoder = Encoder(spec), Decoder(spec)
        for batch in sliced(batches):
            ids = encoder.encode_all(batch.column(1).to_pylist())
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([decoded_digest(decoder.fresh(), x) for x in ids]),
            }
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.cumsum([0] + [len(x) // 4 for x in ids])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more
    )
