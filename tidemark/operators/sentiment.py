"""Sentiment: chunk scores, text polarity and daily aggregates.

Chunks and their scores stay in the row of their text, so that no shuffle is needed to put them
together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.functions.text import CHUNK_OVERLAP, CHUNK_TOKENS, bind, chunk_arrays, clean_social, tokens, weight_sum

# From a cleaned text to ``array<struct<label, score>>``, one entry per chunk.
Scorer = Callable[[Column], Column]
SCORES = "array<struct<label: string, score: double>>"


def lexicon_scorer(lexicon: Mapping[str, float], length: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Scorer:
    """Stand-in for a sentiment model: the sign of the summed word weights of a chunk.

    Score is the share of the weight that agrees with the label, one half where nothing speaks
    for either side. It says nothing about what a trained model would answer.
    """
    up = {w: x for w, x in lexicon.items() if x > 0}
    down = {w: -x for w, x in lexicon.items() if x < 0}

    def chunk_verdict(chunk: Column) -> Column:
        sums = F.struct(weight_sum(chunk, up).alias("up"), weight_sum(chunk, down).alias("down"))
        return bind(sums, _verdict)

    return lambda clean: F.transform(chunk_arrays(tokens(F.lower(clean)), length, overlap), chunk_verdict)


def _verdict(sums: Column) -> Column:
    up, down = sums["up"], sums["down"]
    label = F.when(up > down, "Positive").when(down > up, "Negative").otherwise("Neutral")
    agreeing = F.coalesce(ratio(F.greatest(up, down), up + down), F.lit(0.5))
    return F.struct(label.alias("label"), agreeing.alias("score"))


def model_scorer(
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
    length: int = CHUNK_TOKENS,
    overlap: int = CHUNK_OVERLAP,
    cut: Callable[[str], list] = str.split,
    glue: Callable[[list], str] = " ".join,
) -> Scorer:
    """Scorer around a model: ``load()`` runs once per Python worker and returns ``texts -> verdicts``.

    ``cut`` and ``glue`` are a tokeniser's encoding and decoding; whitespace words by default. All
    chunks of an Arrow batch go to the model in one call. The texts are cut in Python, so that
    the overlaps are not sent twice; Spark 4.1 also mishandles nested lambdas in UDF arguments.
    """

    @F.pandas_udf(SCORES)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            cuts = [cut(text) for text in texts]
            starts = [range(0, len(c), length - overlap) for c in cuts]
            chunks = [glue(c[s : s + length]) for c, ss in zip(cuts, starts) for s in ss]
            verdicts = iter(model(chunks) if chunks else [])
            yield pd.Series([[dict(zip(("label", "score"), next(verdicts))) for _ in ss] for ss in starts])

    return predict


def _votes(scores: Column, label: str) -> Column:
    return F.size(F.filter(scores, lambda s: s["label"] == label))


def _score_sum(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda total, s: total + s["score"])


def majority_label(scores: Column) -> Column:
    """Most frequent label; ties and texts without chunks go Positive, Neutral, Negative."""
    pos, neu, neg = (_votes(scores, x) for x in ("Positive", "Neutral", "Negative"))
    return (
        F.when((pos >= neu) & (pos >= neg), "Positive").when(neu >= neg, "Neutral").otherwise("Negative")
    )


def vote_balance(scores: Column) -> Column:
    """Positive minus negative chunks."""
    return _votes(scores, "Positive") - _votes(scores, "Negative")


def mean_confidence(scores: Column) -> Column:
    """Mean score over all chunks, 0 without chunks."""
    return F.coalesce(ratio(_score_sum(scores), F.size(scores)), F.lit(0.0))


def opinion_confidence(scores: Column) -> Column:
    """Sum of all scores over the number of non-neutral chunks: neutral chunks inflate it."""
    opinions = _votes(scores, "Positive") + _votes(scores, "Negative")
    return _score_sum(scores) / F.greatest(opinions, F.lit(1))


def score_snippets(snippets: DataFrame, scorer: Scorer, clean=clean_social) -> DataFrame:
    """Sentiment, Score and Confidence of every text; empty texts count as Positive with score 0."""
    scored = snippets.withColumn("_scores", scorer(clean(F.col("Text"))))
    scores = F.col("_scores")
    return scored.select(
        *snippets.columns,
        majority_label(scores).alias("Sentiment"),
        vote_balance(scores).alias("Score"),
        mean_confidence(scores).alias("Confidence"),
    )


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Per ticker and day: summed score, mean confidence, number of texts and their ratio."""
    daily = (
        scored.where(F.col("Date").isNotNull())
        .groupBy("Ticker", "Date")
        .agg(
            F.sum("Score").alias("Sent_CumScore"),
            F.avg("Confidence").alias("Sent_Confidence"),
            F.count("Text").alias("Sent_TextCount"),
        )
    )
    return daily.withColumn("Sent_NormScore", ratio(F.col("Sent_CumScore"), F.col("Sent_TextCount")))
