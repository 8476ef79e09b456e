"""Quality rules by weak supervision: rules vote or abstain, a label model weighs the votes.

All work on rows is DataFrame expressions. Every document gets the pattern of its votes. There are at most
4 to the number of rules patterns, whatever the size of the corpus, and expectation-maximisation needs
nothing but their counts. It estimates how right each kind of vote of each rule is; from that every
pattern has a posterior probability of being good.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_chars")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of other characters than space and \\x09-\\x0D; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def repeated_words(found: Column) -> Column:
    """Words in windows of three words that occur twice or more, their first occurrence included.

    Windows are told apart as text. Only where some window repeats are they sorted, each with its place
    behind it, and compared with their neighbours; the places are then merged in order. No word holds the blank
    in front of a place, so equal windows are neighbours.
    """

    def windows(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)),
        )

    def text_of(entry: Column) -> Column:
        return F.substring(entry, F.lit(1), F.length(entry) - 10)

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: text_of(x).eqNullSafe(text_of(F.get(ordered, i + 1))) | text_of(x).eqNullSafe(text_of(F.get(ordered, i - 1))),
        )
        places = F.sort_array(F.transform(twice, lambda x: F.right(x, F.lit(9)).cast("long")))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
            lambda a, s: F.struct(
                (a["n"] + s + 3 - F.greatest(s, a["upto"])).alias("n"), (s + 3).alias("upto")
            ),
            lambda a: a["n"],
        )

    def count(grams: Column) -> Column:
        placed = F.transform(grams, lambda g, i: F.concat(g, F.lit(" "), F.lpad(i.cast("string"), 9, "0")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            _bound(F.sort_array(placed), covered)
        )

    return _bound(windows(found), count)


def statistics(text: Column) -> Column:
    """A struct of the numbers the rules look at; zeros for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    number = lambda c: c.cast("long")

    def of_words(ws: Column) -> Column:
        return F.struct(
            number(F.size(ws)).alias("n_words"),
            number(F.length(F.array_join(ws, ""))).alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(number(F.size(ls)).alias("n_lines"), number(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))

    by_word, by_line = _bound(words(text), of_words), _bound(lines, of_lines)
    return F.struct(
        by_word.alias("w"),
        by_line.alias("l"),
        number(F.regexp_count(text, F.lit(SYMBOL))).alias("n_symbols"),
        number(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
        number(F.regexp_count(text, F.lit(r"[!?]"))).alias("n_marks"),
        number(F.length(text)).alias("n_chars"),
    )


NO_VOTE, GOOD, BAD, DOUBTFUL = range(4)


def _vote(good: Column, bad: Column, doubtful: Column | None = None) -> Column:
    """The code of a vote; none where the numbers say nothing."""
    vote = F.when(bad, BAD)
    if doubtful is not None:
        vote = vote.when(doubtful, DOUBTFUL)
    return vote.when(good, GOOD).otherwise(NO_VOTE)


def rules() -> dict[str, Column]:
    """The votes, over the columns of ``STATISTICS``."""
    n, ratio = F.col("n_words"), lambda c, by: F.col(c) / F.greatest(F.col(by), F.lit(1))
    some = n > 0
    length, symbols, marks = ratio("word_chars", "n_words"), ratio("n_symbols", "n_words"), ratio("n_marks", "n_words")
    lines, repeats, upper = ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_upper", "word_chars")
    return {
        "words": _vote(n >= 2 * MIN_WORDS, n < MIN_WORDS // 2, n < MIN_WORDS),
        "word_length": _vote(some & length.between(3, 9), ~some | (length < 2) | (length > 14), length > 11),
        "symbols": _vote(some & (symbols < 0.02), symbols > 0.2, symbols > 0.1),
        "lines": _vote((F.col("n_lines") > 1) & (lines < 0.1), lines > 0.6, lines > 0.4),
        "repeats": _vote(some & (repeats < 0.1), repeats > 0.5, repeats > 0.3),
        "capitals": _vote(some & (upper < 0.1), upper > 0.4, upper > 0.3),
        "marks": _vote(some & (marks < 0.05), marks > 0.5, marks > 0.2),
    }


BELIEF = {BAD: 0.95, DOUBTFUL: 0.4}  # the probability that a document with such a vote is bad, before any is seen
BELIEF_WEIGHT = 2.0  # of the beliefs in the estimates, in documents
USUAL = {GOOD: 0.96, BAD: 0.01, DOUBTFUL: 0.03}  # votes on a good document, before any is seen
UNSEEN = 0.005  # part of the bad documents in which no rule finds fault though all of them vote
HELD = 2.0  # the odds that the beliefs about a pattern's faults keep, at most
ROUNDS = 100
STARTING_SHARES = (0.05, 0.15, 0.3, 0.5, 0.7)  # of bad documents, at the starts of the independent model
INDEPENDENT_ROUNDS = 5  # times as many for the independent model, which converges slowly where rules err often


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p) - math.log(1 - p)


def _trusted(rule: int, counts: Mapping[tuple[int, ...], int]) -> bool:
    """Whether a rule's bad votes are believed at the start: not if the other rules contradict them.

    They do if the rule finds fault with most of the documents it votes on and the others hardly ever with the same ones;
    or if it finds fault alone oftener than all others together do, and as often without them as with them.
    """
    number = {(bad, others): 0 for bad in (False, True) for others in (False, True)}
    for p, n in counts.items():
        if p[rule] != NO_VOTE:
            number[p[rule] == BAD, any(vote in BELIEF for i, vote in enumerate(p) if i != rule)] += n
    alone, along = number[True, False], number[True, True]
    without, beside = alone + number[False, False], along + number[False, True]
    if 2 * (alone + along) > without + beside and along < alone:
        return False
    alike = alone * beside < 2 * along * without and along * without < 2 * alone * beside
    return not (alike and alone * (without + beside) > beside * without)


def label_model(counts: Mapping[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each pattern of votes, from the patterns' counts; patterns are at most 4 to the number of rules.

    Two models are fitted by expectation-maximisation. In one, all rules judge independently, each with its own accuracy on good and on bad documents:
    lone bad votes of rules that err often are outvoted. In the other bad documents are of kinds, one for
    the fault that each rule sees, and rules for other faults are pleased with them: then bad votes hardly meet, and that they don't is no
    evidence against them. The first is taken where it makes the counts likelier, for its number of parameters (AIC), than the
    second and than the strict form of that, in which a rule that sees nothing votes as on good documents. A missing vote says nothing.
    """
    if not sum(counts.values()):
        return {}
    rules, most = len(next(iter(counts))), len(counts) - 1  # no model can use more parameters than tell the patterns apart
    free = sum(max(len({p[rule] for p in counts} - {NO_VOTE}) - 1, 0) for rule in range(rules))
    best, fit = _kinds_model(counts, rounds)
    score = max(fit - min((rules + 1) * free + rules, most), _exclusive_fit(counts, rounds) - min(2 * free + rules, most))
    for start in _starts(counts):
        independent, fit = _independent_model(counts, start, rounds)
        fit -= min(2 * free + 1, most)
        if independent and fit > score:
            best, score = independent, fit
    return best


def _starts(counts: Mapping[tuple[int, ...], int]) -> Iterator[dict[tuple[int, ...], float]]:
    """First posteriors of good for the independent model: the documents with most fault found, for several shares of bad ones."""
    if len(next(iter(counts))) < 3:
        return  # two rules' accuracies can't be told from their agreement

    def fault(p: tuple[int, ...]) -> float:
        cast = [vote for vote in p if vote != NO_VOTE]
        return sum(BELIEF.get(vote, 0.0) for vote in cast) / len(cast) if cast else 0.0

    ordered = sorted(counts, key=lambda p: (-fault(p), p))
    total = sum(counts.values())
    for share in STARTING_SHARES:
        good, seen = {}, 0
        for p in ordered:
            good[p] = 0.1 if seen < share * total else 0.9
            seen += counts[p]
        yield good


def _independent_model(
    counts: Mapping[tuple[int, ...], int], good: dict[tuple[int, ...], float], rounds: int
) -> tuple[dict[tuple[int, ...], float], float]:
    """Posteriors and log-likelihood of two classes with independent votes; nothing if hardly a rule tells them apart the right way round.

    Each rule's votes on a class keep one document of a weak belief that all votes can happen.
    """
    n_rules, total = len(next(iter(counts))), sum(counts.values())
    cast = {p: [(rule, vote) for rule, vote in enumerate(p) if vote != NO_VOTE] for p in counts}
    fit = -math.inf
    for _ in range(INDEPENDENT_ROUNDS * rounds):
        votes = [{(rule, vote): 1 / 3 for rule in range(n_rules) for vote in (GOOD, BAD, DOUBTFUL)} for _ in range(2)]
        for p, n in counts.items():
            for key in cast[p]:
                votes[0][key] += n * good[p]
                votes[1][key] += n * (1 - good[p])
        for one in votes:
            for rule in range(n_rules):
                whole = sum(one[rule, vote] for vote in (GOOD, BAD, DOUBTFUL))
                for vote in (GOOD, BAD, DOUBTFUL):
                    one[rule, vote] /= whole
        share = (sum(n * good[p] for p, n in counts.items()) + 1) / (total + 2)
        before, fit, good = fit, 0.0, {}
        for p, n in counts.items():
            on_good = math.log(share) + sum(math.log(votes[0][key]) for key in cast[p])
            on_bad = math.log(1 - share) + sum(math.log(votes[1][key]) for key in cast[p])
            top = max(on_good, on_bad)
            both = top + math.log(math.exp(on_good - top) + math.exp(on_bad - top))
            good[p] = math.exp(on_good - both)
            fit += n * both
        if fit - before < 1e-7 * total:
            break
    right = sum(votes[1][rule, GOOD] < votes[0][rule, GOOD] for rule in range(n_rules))
    return (good, fit) if 2 * right > n_rules else ({}, fit)


def _exclusive_fit(counts: Mapping[tuple[int, ...], int], rounds: int) -> float:
    """Log-likelihood of kinds of bad documents in which one rule each has its own votes and all others vote as on good ones."""
    n_rules, total, votes = len(next(iter(counts))), sum(counts.values()), (GOOD, BAD, DOUBTFUL)
    cast = {p: [(rule, vote) for rule, vote in enumerate(p) if vote != NO_VOTE] for p in counts}
    usual = {(rule, vote): USUAL[vote] for rule in range(n_rules) for vote in votes}
    own = {(rule, vote): {GOOD: 0.02, BAD: 0.9, DOUBTFUL: 0.08}[vote] for rule, vote in usual}
    sizes, fit = [0.9] + [0.1 / n_rules] * n_rules, -math.inf  # good documents, then the kinds
    for _ in range(INDEPENDENT_ROUNDS * rounds):
        on_usual, on_own, number = dict.fromkeys(usual, 1 / 3), dict.fromkeys(own, 1 / 3), [1.0] * (n_rules + 1)
        before, fit = fit, 0.0
        for p, n in counts.items():
            clear = math.prod(usual[key] for key in cast[p])
            likely = [sizes[0] * clear] + [0.0] * n_rules
            for rule, vote in cast[p]:
                likely[rule + 1] = sizes[rule + 1] * clear * own[rule, vote] / usual[rule, vote]
            whole = max(sum(likely), 1e-300)
            fit += n * math.log(whole)
            parts = [n * x / whole for x in likely]
            number = [a + b for a, b in zip(number, parts, strict=True)]
            for key in cast[p]:
                on_own[key] += parts[key[0] + 1]
                on_usual[key] += n - parts[key[0] + 1]
        for table, sums in ((usual, on_usual), (own, on_own)):
            for rule in range(n_rules):
                whole = sum(sums[rule, vote] for vote in votes)
                table.update({(rule, vote): sums[rule, vote] / whole for vote in votes})
        sizes = [x / sum(number) for x in number]
        if fit - before < 1e-7 * total:
            break
    return fit


def _kinds_model(counts: Mapping[tuple[int, ...], int], rounds: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Posteriors and log-likelihood with as many kinds of bad documents as rules, one for the fault that each sees.

    By turns, the documents' posteriors follow from how likely each vote of each rule is
    on good documents and on each kind of bad ones, and these likelihoods from the posteriors.
    In a small part of the bad documents (``UNSEEN`` where all rules vote, more where fewer do) no rule sees
    one. The beliefs, for rules that the others don't contradict, give the
    start; afterwards likelihoods keep ``BELIEF_WEIGHT`` documents of them, and a pattern with faults odds of ``HELD`` at most.
    """
    total = sum(counts.values())
    patterns = sorted(counts)
    n_rules, kinds = len(patterns[0]), (GOOD, BAD, DOUBTFUL)
    believed = {rule for rule in range(n_rules) if _trusted(rule, counts)}
    cast = {p: [(rule, vote) for rule, vote in enumerate(p) if vote != NO_VOTE] for p in patterns}
    faults = {p: [rule for rule, vote in cast[p] if vote in BELIEF] for p in patterns}
    unseen = {p: UNSEEN ** (len(cast[p]) / n_rules) for p in patterns}
    at_first = {p: math.prod(1 - BELIEF[p[rule]] for rule in faults[p] if rule in believed or p[rule] == DOUBTFUL) for p in patterns}
    held = {p: min(max(_logit(chance), -math.log(HELD)), math.log(HELD)) for p, chance in at_first.items()}
    good = dict(at_first)
    of_kind = {p: {rule: (1 - good[p]) / len(faults[p]) for rule in faults[p]} for p in patterns}
    for _ in range(rounds):
        on_good = {(rule, vote): BELIEF_WEIGHT * USUAL[vote] for rule in range(n_rules) for vote in kinds}
        on_bad = {(kind, *key): BELIEF_WEIGHT * (USUAL[key[1]] if kind != key[0] else BELIEF.get(key[1], 0.0)) for kind in range(n_rules) for key in on_good}
        size = [BELIEF_WEIGHT / n_rules] * n_rules
        for p in patterns:
            for key in cast[p]:
                on_good[key] += counts[p] * good[p]
                for kind, part in of_kind[p].items():
                    on_bad[(kind, *key)] += counts[p] * part
            for kind, part in of_kind[p].items():
                size[kind] += counts[p] * part
        for votes in (on_good, on_bad):
            sums: dict[tuple, float] = {}
            for key, n in votes.items():
                sums[key[:-1]] = sums.get(key[:-1], 0.0) + n
            for key in votes:
                votes[key] /= sums[key[:-1]]
        share = (sum(counts[p] * good[p] for p in patterns) + BELIEF_WEIGHT / 2) / (total + BELIEF_WEIGHT)
        share = min(max(share, 0.01), 0.99)
        before, good, fit = good, {}, 0.0
        for p in patterns:
            odds = _logit(share)
            clean = share * math.prod(on_good[key] for key in cast[p])
            if faults[p]:
                clear = math.prod(on_good[rule, GOOD] for rule, _ in cast[p])
                likely = {kind: size[kind] / sum(size) * math.prod(on_bad[(kind, *key)] for key in cast[p]) for kind in faults[p]}
                bad = max(sum(likely.values()), 1e-300)
                odds += held[p] + sum(math.log(on_good[key]) for key in cast[p]) - math.log(1 - unseen[p] * clear) - math.log(bad)
            else:
                odds -= math.log(unseen[p])
            good[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            of_kind[p] = {kind: (1 - good[p]) * x / bad for kind, x in likely.items()} if faults[p] else {}
            hidden = unseen[p] * math.prod(on_good[key] for key in cast[p])
            fit += counts[p] * math.log(max(clean + (1 - share) * (sum(likely.values()) if faults[p] else hidden), 1e-300))
        if max(abs(good[p] - before[p]) for p in patterns) < 1e-4:
            break
    return good, fit


def _scored(documents: DataFrame, kept: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The kept columns with statistics and vote pattern, written once; and the names these columns got."""
    names = {c: free_name(c, kept) for c in (*STATISTICS, "pattern")}
    inner = free_name("statistics", documents.columns)
    with_numbers = documents.select(*(documents[f"`{c}`"] for c in kept), statistics(documents["text"]).alias(inner))
    where = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    flat = with_numbers.select(
        *(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(kept)),
        *((F.col(inner)[where[c]][c] if c in where else F.col(inner)[c]).alias(c) for c in STATISTICS),
    )
    pattern = F.concat(*(v.cast("string") for v in rules().values())).alias("pattern")
    flat = flat.select("*", pattern)
    renamed = flat.select(*(F.col(f"kept{i}").alias(c) for i, c in enumerate(kept)), *(F.col(c).alias(n) for c, n in names.items()))
    return written(renamed, "quality"), names


def _judged(table: DataFrame, names: dict[str, str], threshold: float) -> tuple[DataFrame, str, str]:
    """Adds ``base_failed`` and the posterior to a scored table; returns it with the names of the two columns."""
    counts = {
        tuple(map(int, p)): n for p, n in table.groupBy(F.col(names["pattern"])).count().collect()  # at most 4 ** rules rows
    }
    good = label_model(counts)
    failed, chance = free_name("base_failed", table.columns), free_name("p_good", table.columns)
    number = {c: table[f"`{n}`"] for c, n in names.items()}
    base = (number["n_words"] < MIN_WORDS) | (100 * number["n_repeat_words"] > MAX_REPEATED_PERCENT * number["n_words"])
    if not good:
        return table.select("*", base.alias(failed), F.lit(None).cast("double").alias(chance)), failed, chance
    key = free_name("pattern_key", table.columns)
    entries = [F.struct(F.lit("".join(map(str, p))).alias(key), F.lit(v).alias(chance)) for p, v in good.items()]
    model = table.sparkSession.range(1).select(F.inline(F.array(*entries)))
    joined = table.join(F.broadcast(model), number["pattern"] == F.col(key))
    return joined.select(*(table[f"`{c}`"] for c in table.columns), base.alias(failed), F.col(chance)), failed, chance


def quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the numbers, ``base_failed``, ``p_good`` and ``kept`` of every row of ``documents``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows of three.
    ``kept``: not failed, and a posterior of ``threshold`` or more. Null texts count as empty. Equal texts
    get equal results, repeated rows and null ids are judged like any row, an empty table gives none.
    """
    table, names = _scored(documents.select("doc_id", "text"), ["doc_id"])
    judged, failed, chance = _judged(table, names, threshold)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col(failed).alias("base_failed"), F.col(chance).alias("p_good"),
        (~F.col(failed) & (F.col(chance) >= threshold)).alias("kept"),
    )


def of_quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that :func:`quality` keeps, with all their columns."""
    table, names = _scored(documents, documents.columns)
    judged, failed, chance = _judged(table, names, threshold)
    return judged.where(~F.col(failed) & (F.col(chance) >= threshold)).select(*(F.col(f"`{c}`") for c in documents.columns))
