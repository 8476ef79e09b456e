"""Valence rules for lexicon scores, as a state machine over the words of a text that have a weight.

The rules are those of the published VADER model (Hutto and Gilbert, 2014): a word's weight grows with capitals and with boosters
up to three words before it, is turned by a negation there, counts half before the first "but" and half more
after it, and exclamation and question marks strengthen the sum. Weights come as a parameter. Left out: idioms, emoticons, the two-word
boosters "kind of" and "sort of", and the special rule for "no".

As Column expressions the machine costs microseconds a word, since lambdas are interpreted and carry three words along as structs; the
rules run in an Arrow function, which looks up what it knows of a word and stops only at those with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rules.
CAPITALS, NEGATED, NEVER_SO = 0.733, -0.74, 1.25
RAISE, LOWER = 0.293, -0.293
DAMPED = (1.0, 0.95, 0.9)  # a booster next to the word, and one or two words further off
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
SPREAD = 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Words that raise or lower the next weights, and words that turn them ("n't" does so anywhere in a word).
BOOSTERS = dict.fromkeys((
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously", "entirely", "especially",
    "exceptionally", "extremely", "fabulously", "fully", "greatly", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously",
    "unbelievably", "unusually", "utterly", "very",
), RAISE) | dict.fromkeys((
    "almost", "barely", "hardly", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat",
), LOWER)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "mustnt", "neither", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt", "rarely", "seldom", "despite",
)

CACHED_WORDS = 200_000
TEXTS_AT_ONCE = 256  # held as Python strings; an Arrow batch may have many more
SCORES = ("compound", "pos", "neg", "neu")


class _Word(NamedTuple):
    """What the rules ask about a word."""

    low: str
    up: bool
    weight: float | None
    boost: float | None
    turns: bool
    stops: bool  # has an effect of its own: a weight, or the "but" that turns the text


_NOTHING = _Word("", False, None, None, False, False)


def _known_words(lexicon: Mapping[str, float], boosters: Mapping[str, float], negations: Collection[str]) -> Callable[[list[str]], list[_Word]]:
    """Words without the punctuation around them (short ones keep it), looked at once each."""
    negations, seen = frozenset(negations), {}

    def look(token: str) -> _Word:
        stripped = token.strip(PUNCTUATION)
        word = token if len(stripped) <= 2 else stripped
        low = word.lower()
        weight, boost = lexicon.get(low), boosters.get(low)
        stops = low == "but" or (bool(weight) and boost is None)
        return _Word(low, word.upper() == word and low != word, weight, boost, low in negations or "n't" in low, stops)

    def words(tokens: list[str]) -> list[_Word]:
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for token in set(tokens).difference(seen):
            seen[token] = look(token)
        return [seen[token] for token in tokens]

    return words


def _influenced(value: float, before: tuple[_Word, _Word, _Word], mixed: bool) -> float:
    """The weight of a word after the three words before it, the nearest first; a known word has no influence."""
    for place, near in enumerate(before):
        if near.weight is not None:
            continue
        if near.boost is not None:
            capital = (CAPITALS if value > 0 else -CAPITALS) if near.up and mixed else 0.0
            value += ((-near.boost if value < 0 else near.boost) + capital) * DAMPED[place]
        between = [w.low for w in before[:place]]
        if near.low == "never" and ("so" in between or "this" in between):
            value *= NEVER_SO
        elif near.turns and not (near.low == "without" and "doubt" in between):
            value *= NEGATED
    nearest, second, _ = before
    if nearest.low == "least" and nearest.weight is None and second.low not in ("at", "very"):
        value *= NEGATED
    return value


def _sums(words: list[_Word]) -> tuple[float, float, int, int]:
    """Sums and numbers of the weights above and below 0."""
    capitals = sum(w.up for w in words)
    mixed = 0 < capitals < len(words)
    after_but, up, down, ups, downs = False, 0.0, 0.0, 0, 0
    for i in [i for i, w in enumerate(words) if w.stops]:
        word, value = words[i], 0.0
        if word.weight and word.boost is None:
            own = word.weight + (math.copysign(CAPITALS, word.weight) if word.up and mixed else 0.0)
            before = tuple(words[i - k] if i >= k else _NOTHING for k in (1, 2, 3))
            value = _influenced(own, before, mixed) * (AFTER_BUT if after_but else 1.0)
        if word.low == "but" and not after_but:
            after_but, up, down = True, up * BEFORE_BUT, down * BEFORE_BUT
        up, down, ups, downs = up + max(value, 0.0), down + min(value, 0.0), ups + (value > 0), downs + (value < 0)
    return up, down, ups, downs


def _scored(text: str, words: list[_Word]) -> tuple[float, float, float, float]:
    up, down, ups, downs = _sums(words)
    questions = text.count("?")
    emphasis = min(text.count("!"), MOST_EXCLAMATIONS) * EXCLAMATION + (0.0 if questions <= 1 else questions * QUESTION if questions <= 3 else MANY_QUESTIONS)
    total = up + down
    strong = total + (math.copysign(emphasis, total) if total else 0.0)
    # Each word with a weight counts one more, to be on a par with the words without.
    rest, up, down = len(words) - ups - downs, up + ups, downs - down
    positive, negative = up + (emphasis if up > down else 0.0), down + (emphasis if up < down else 0.0)
    whole = positive + negative + rest
    shares = (positive / whole, negative / whole, rest / whole) if whole else (0.0, 0.0, 0.0)
    return strong / math.sqrt(strong * strong + SPREAD), *shares


def valence(
    text: Column, lexicon: Mapping[str, float], boosters: Mapping[str, float] = BOOSTERS, negations: Collection[str] = NEGATIONS
) -> Column:
    """``struct<compound, pos, neg, neu>`` of a text. All word lists are lower case; NULL is an empty text."""
    lists = dict(lexicon), dict(boosters), tuple(negations)

    def score(texts: pa.Array) -> pa.Array:
        words, rows = _known_words(*lists), []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            for value in texts.slice(start, TEXTS_AT_ONCE).to_pylist():
                rows.append(_scored(value or "", words((value or "").split())))
        columns = zip(*rows, strict=True) if rows else ((),) * len(SCORES)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=list(SCORES))

    return F.arrow_udf(score, ", ".join(f"{n} double" for n in SCORES))(text)
