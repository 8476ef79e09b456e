"""Text baselines: lexicon scores, with and without valence rules, and TF-IDF terms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.functions.text import bind, clean_social, tokens, weight_sum
from tidemark.functions.valence import valence


def lexicon_score(texts: DataFrame, key: str, text: str, lexicon: Mapping[str, float]) -> DataFrame:
    """Summed weight and mean weight per word of every text, within its row."""
    words = tokens(F.lower(clean_social(F.col(text))))
    scored = texts.select(key, bind(words, lambda w: F.struct(F.size(w).alias("n"), weight_sum(w, lexicon).alias("s"))).alias("_"))
    return scored.select(
        key, F.col("_.n").alias("words"), F.col("_.s").alias("score"), ratio(F.col("_.s"), F.col("_.n")).alias("mean_score")
    )


def valence_score(texts: DataFrame, key: str, text: str, lexicon: Mapping[str, float], **words) -> DataFrame:
    """``compound`` in [-1, 1] and the shares ``pos``, ``neg``, ``neu`` of every text by the valence rules; one row per text, no shuffle.

    NULL, empty and blank texts score 0 throughout. ``words`` may replace the boosters and negations, see :func:`functions.valence.valence`.
    """
    scored = texts.select(key, valence(F.col(text), lexicon, **words).alias("_"))
    return scored.select(key, *(F.col(f"_.{n}").alias(n) for n in ("compound", "pos", "neg", "neu")))


def tfidf(texts: DataFrame, key: str, text: str, common_terms: int = 10_000) -> DataFrame:
    """tf * log((N + 1) / (df + 1)) of every term of every text.

    Term counts collapse on the map side. A common term stands in nearly every text, so it must not
    become one join key of a shuffle: terms that make up more than one ``common_terms``-th of all
    words, of which there can be no more than that many, are broadcast. The rest is joined by term.

    Every branch reads the same columns of the term counts, so that Spark computes them once.
    """
    words = texts.select(key, F.explode(tokens(F.lower(clean_social(F.col(text))))).alias("term"))
    tf = words.where(F.col("term").isNotNull()).groupBy(key, "term").agg(F.count("*").alias("tf"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))
    n = texts.agg(F.count("*")).scalar()
    # The total reads the number of texts too, or it would be a shuffle of its own.
    total = terms.agg(F.sum(F.when(F.col("df") > 0, F.col("uses")))).scalar()
    is_common = F.col("uses") * common_terms > total
    idf = F.log((n + 1) / (F.col("df") + 1)).alias("idf")
    common = F.broadcast(terms.where(is_common).select(F.col("term").alias("_common"), idf))
    rare = terms.where(~is_common).select(F.col("term").alias("_key"), idf.alias("rare_idf"))
    # Rows that are served already are spread over keys that match nothing.
    marked = tf.join(common, F.col("term") == F.col("_common"), "left")
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(key), F.lit(997)))
    keyed = marked.withColumn("_key", F.when(F.col("idf").isNull(), F.col("term")).otherwise(spread))
    joined = keyed.join(rare, "_key", "left").withColumn("idf", F.coalesce("idf", "rare_idf"))
    return joined.select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def top_terms(weights: DataFrame, key: str, n: int = 5, digits: int = 6) -> DataFrame:
    """The ``n`` heaviest terms of every text; equal weights go by term."""
    by_weight = Window.partitionBy(key).orderBy(F.round("tfidf", digits).desc(), "term")
    ranked = weights.withColumn("rank", F.row_number().over(by_weight))
    return ranked.where(F.col("rank") <= n)
