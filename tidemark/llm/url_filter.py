"""URL filter: rules decide first, gradient-boosted trees on lexical features decide the rest.

The trees learn from labelled URLs, here those that a rule decides. Besides the shape of a URL they see how
often labelled URLs with the same host suffixes and the same first path segment are blocked. The shares are of
all labelled URLs, the trees learn from a sample. For training the hosts of a fold are taken off, so that no URL sees labels of
its own host, and suffixes and segments that a rule names have no share at all: else the trees would only repeat the rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, written

SAMPLE = 10_000  # labelled URLs that the trees learn from, at most
FOLDS = 5
WEIGHT = 5.0  # of the overall share in a suffix's share, in URLs

Rule = tuple[str, str]  # allow or block, host/path

LEXICAL = (
    "length", "host_length", "path_length", "depth", "labels", "digit_share", "letter_entropy", "parameters", "hyphens",
    "has_fragment", "is_https",
)
SUFFIXES = ("last_label", "last_two", "whole_host", "first_segment")
PARENT = {"last_two": "last_label", "whole_host": "last_two"}  # whose share stands in where a suffix has no labels


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits: its host or a subdomain, and its path in front. Null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first, so it comes last here
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _entropy(text: Column) -> Column:
    """Bits per character."""

    def of(letters: Column) -> Column:
        def add(total: Column, letter: Column) -> Column:
            share = F.size(F.filter(letters, lambda c: c == letter)) / F.size(letters)
            return total - share * F.log2(share)

        return F.aggregate(F.array_distinct(letters), F.lit(0.0), add)

    return F.when(F.length(text) > 0, _once(F.split(text, ""), of)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features of a URL's shape; null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    length = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.array_remove(F.split(path, "/"), "")),
        "labels": F.size(F.array_remove(F.split(host, r"\."), "")),
        "digit_share": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
        "letter_entropy": _entropy(url),
        "parameters": F.size(F.array_remove(F.split(query, "&"), "")),
        "hyphens": F.regexp_count(url, F.lit("-")),
        "has_fragment": url.contains("#"),
        "is_https": url.startswith("https://"),
    }
    return {k: v.cast("double") for k, v in found.items()}


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Parts of a URL whose share of blocked URLs is a feature."""
    return {
        "last_label": F.substring_index(host, ".", -1),
        "last_two": F.substring_index(host, ".", -2),
        "whole_host": host,
        "first_segment": F.regexp_extract(path, r"^/*([^/]*)", 1),
    }


def _unnamed(parts: dict[str, Column], rules: Sequence[Rule]) -> dict[str, Column]:
    """The parts, null where they are a rule's first segment, its host or a suffix of that."""
    named: dict[str, set[str]] = {part: set() for part in SUFFIXES}
    for _, text in rules:
        domain, _, tail = text.partition("/")
        labels = domain.split(".")
        named["last_label"].add(labels[-1])
        named["last_two"].add(".".join(labels[-2:]))
        named["whole_host"].update(".".join(labels[i:]) for i in range(len(labels)))
        named["first_segment"].update([tail.split("/")[0]] if tail else [])
    return {part: F.when(~value.isin(sorted(named[part])), value) if named[part] else value for part, value in parts.items()}


class Judge:
    """Trained trees and the shares of blocked URLs; or one verdict for all, if the labels were of one kind."""

    def __init__(self, model: GBTClassificationModel | None, shares: DataFrame | None, overall: float):
        self.model, self.shares, self.overall = model, shares, overall

    def scored(self, urls: DataFrame, url: str, host: str, path: str, score: str) -> DataFrame:
        """``urls`` with the probability that a URL is to be blocked as ``score``.

        The shares (``part``, ``key``, ``share``) may be as many as labelled URLs, so how they are joined is left to Spark.
        """
        if self.model is None:
            return urls.withColumn(score, F.lit(self.overall))
        rows = urls
        names = {c: free_name(f"url_{c}", urls.columns) for c in (*LEXICAL, *SUFFIXES)}
        rows = rows.withColumns({names[c]: v for c, v in lexical(F.col(url), F.col(host), F.col(path)).items()})
        for part, value in suffixes(F.col(host), F.col(path)).items():
            table = self.shares.where(F.col("part") == part).select(F.col("key").alias(f"{names[part]}_key"), F.col("share").alias(names[part]))
            rows = rows.join(table, value == F.col(f"{names[part]}_key"), "left").drop(f"{names[part]}_key")
            parent = F.col(names[PARENT[part]]) if part in PARENT else F.lit(self.overall)
            rows = rows.withColumn(names[part], F.coalesce(names[part], parent))
        vector = free_name("url_features", rows.columns)
        rows = VectorAssembler(inputCols=[names[c] for c in (*LEXICAL, *SUFFIXES)], outputCol=vector).transform(rows)
        model = self.model.copy().setFeaturesCol(vector).setPredictionCol("").setRawPredictionCol("").setProbabilityCol(vector + "_p")
        rows = model.transform(rows)
        return rows.select(*(F.col(f"`{c}`") for c in urls.columns), vector_to_array(vector + "_p")[1].alias(score))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 5, rules: Sequence[Rule] = ()) -> Judge:
    """Learns from ``labelled`` (``url``, ``host``, ``path``, ``label``; 1 is block). ``rules`` are those that gave the labels, if any did.

    Suffix shares count all distinct URLs; the trees learn from at most ``sample``, the first by a hash, which reach the driver. Without labels
    nothing is blocked; with one kind of label all URLs get it.
    """
    spark = labelled.sparkSession
    every = labelled.where("url is not null").select("url", "host", "path", F.col("label").cast("int").alias("label")).distinct()
    parts = _unnamed(suffixes(F.col("host"), F.col("path")), rules)
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    listed = F.array(F.struct(F.lit("").alias("part"), F.lit("").alias("key")), *(F.struct(F.lit(k).alias("part"), v.alias("key")) for k, v in parts.items()))
    counted = cut(
        every.select("label", fold.alias("fold"), F.explode(listed).alias("s")).where("s.key is not null").groupBy("s.part", "s.key", "fold")
        .agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    )
    total = counted.where("part = ''").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total.n or total.bad in (0, total.n):
        return Judge(None, None, 1.0 if total.bad else 0.0)
    overall = total.bad / total.n
    shape = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = (
        every.orderBy(F.xxhash64("url"), "url", "label").limit(sample)
        .select("label", fold.alias("fold"), *(v.alias(c) for c, v in {**shape, **parts}.items()))
        .collect()
    )
    wanted = spark.createDataFrame(sorted({(part, r[part]) for r in rows for part in SUFFIXES if r[part] is not None}), "part string, key string")
    counts: dict[tuple, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in counted.join(F.broadcast(wanted), ["part", "key"], "left_semi").collect():  # at most FOLDS for every part of the sample
        counts[r.part, r.key][r.fold] = r.n, r.bad

    def share(number, bad):
        return (bad + WEIGHT * overall) / (number + WEIGHT)

    data = []
    for r in rows:
        seen: dict[str, float] = {}
        for part in SUFFIXES:
            others = [c for own, c in counts.get((part, r[part]), {}).items() if own != r.fold]
            parent = seen[PARENT[part]] if part in PARENT else overall
            seen[part] = share(sum(n for n, _ in others), sum(bad for _, bad in others)) if others else parent
        data.append((*(float(r[c]) for c in LEXICAL), *(seen[p] for p in SUFFIXES), float(r.label)))
    columns = [*LEXICAL, *SUFFIXES]
    frame = spark.createDataFrame(data, ", ".join(f"{c} double" for c in [*columns, "label"])).coalesce(1)
    frame = VectorAssembler(inputCols=columns, outputCol="features").transform(frame).select("features", "label")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1).fit(frame)
    summed = counted.where("part <> ''").groupBy("part", "key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return Judge(model, summed.select("part", "key", share(F.col("n"), F.col("bad")).alias("share")), overall)


def judged(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, judge: Judge | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` of every row of ``pages`` (``page_id``, ``url``).

    A rule's verdict holds; where none fits, block from ``threshold`` on. Without a ``judge`` one is
    trained on the URLs that rules decide. Null URLs, and those without ``://``, have an empty host and path and are judged
    by the trees. Repeated rows are judged alike, URLs of any length whole; an empty table gives an empty one; other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    split = split.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if judge is None:
        split = written(split, "urls")  # read for the shares, the sample and the verdicts
        judge = train(split.where("rule is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("label")), rules=rules)
    scored = judge.scored(split, "url", "host", "path", "p_block")
    by_trees = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"), "p_block")
