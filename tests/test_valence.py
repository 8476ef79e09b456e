"""Valence rules: a row for each, and all texts against a plain version."""

import math
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.valence import BOOSTERS, NEGATIONS, valence
from tidemark.operators.baselines import valence_score

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "least": 0.5, "very": 1.0, "fine": 0.8, "zero": 0.0}


def plain(text, lexicon):
    """The rules once more, word by word with the list at hand."""
    words = []
    for token in (text or "").split():
        bare = token.strip(string.punctuation)
        words.append(token if len(bare) <= 2 else bare)
    low = [w.lower() for w in words]
    capitals = sum(w.isupper() for w in words)
    mixed = 0 < capitals < len(words)

    def turns(w):
        return w in NEGATIONS or "n't" in w

    values = []
    for i, w in enumerate(low):
        if w not in lexicon or w in BOOSTERS or lexicon[w] == 0:
            values.append(0.0)
            continue
        v = lexicon[w]
        if words[i].isupper() and mixed:
            v += math.copysign(0.733, v)
        for back in (1, 2, 3):
            if i < back or low[i - back] in lexicon:
                continue
            other = low[i - back]
            if other in BOOSTERS:
                s = BOOSTERS[other] * (-1 if v < 0 else 1)
                if words[i - back].isupper() and mixed:
                    s += 0.733 if v > 0 else -0.733
                v += s * (1, 0.95, 0.9)[back - 1]
            between = low[i - back + 1 : i]
            if back > 1 and other == "never" and {"so", "this"} & set(between):
                v *= 1.25
            elif back > 1 and other == "without" and "doubt" in between:
                pass
            elif turns(other):
                v *= -0.74
        if i and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= -0.74
        values.append(v)
    if "but" in low:
        at = low.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
    questions = (text or "").count("?")
    emphasis = min((text or "").count("!"), 4) * 0.292 + (0 if questions < 2 else questions * 0.18 if questions < 4 else 0.96)
    total = sum(values)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    up, down, rest = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0), sum(v == 0 for v in values)
    up, down = up + emphasis * (up > down), down + emphasis * (down > up)
    whole = up + down + rest
    return (total / math.sqrt(total * total + 15), *((up / whole, down / whole, rest / whole) if whole else (0, 0, 0)))


SMALL = {w: x for w, x in LEXICON.items() if w not in ("least", "very")}
RULES = [
    ("good", 1.9), ("a GOOD day", 1.9 + 0.733), ("ALL GOOD", 1.9), ("very good", 1.9 + 0.293), ("slightly good", 1.9 - 0.293), ("VERY good", 1.9 + 0.293 + 0.733),
    ("very bad", -2.5 - 0.293), ("very much good", 1.9 + 0.293 * 0.95), ("very x y good", 1.9 + 0.293 * 0.9), ("not good", -0.74 * 1.9), ("isn't all that good", -0.74 * 1.9),
    ("not a b c good", 1.9), ("never so good", 1.25 * (1.9 + 0.293)), ("without a doubt good", 1.9), ("least good", -0.74 * 1.9), ("at least good", 1.9),
    ("good but bad", 0.95 - 3.75), ("good!", 1.9 + 0.292), ("good!!!!!!", 1.9 + 4 * 0.292), ("bad!", -2.5 - 0.292), ("good?", 1.9), ("good??", 1.9 + 0.36), ("good?????", 1.9 + 0.96),
    ("'good',", 1.9), ("zero x!", 0.0), ("nothing to say!", 0.0), ("", 0.0), (None, 0.0), (" \n\t", 0.0),
]


@pytest.mark.parametrize(("text", "total"), RULES)
def test_rules(value, text, total):
    got = value(valence(F.lit(text).cast("string"), SMALL))
    assert got.compound == pytest.approx(total / math.sqrt(total * total + 15))
    assert tuple(got) == pytest.approx(plain(text, SMALL))


TOKENS = ["good", "GREAT", "Bad!", "horrible", "very", "VERY", "slightly", "not", "isn't", "never", "so", "this", "without", "doubt", "least", "at", "but", "But", "x", "É", "fine?", "??", "!!", ":)", "zero", "I"]


def test_any_words(spark):
    texts = []

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.sampled_from(TOKENS), max_size=14))
    def collect(words):
        texts.append(" ".join(words))

    collect()
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for lexicon in (LEXICON, SMALL):
        for row in valence_score(frame, "id", "text", lexicon).collect():
            assert tuple(row)[1:] == pytest.approx(plain(texts[row.id], lexicon)), texts[row.id]


def test_all_documents(spark):
    lexicon = {"the": 1.5, "and": 0.4, "of": -1.0, "to": -0.3, "der": 0.7, "la": -2.0, "very": 1.0}
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = dict(documents.collect())
    rows = valence_score(documents, "doc_id", "text", lexicon).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row)[1:] == pytest.approx(plain(texts[row.doc_id], lexicon), abs=1e-9)


def test_own_word_lists_and_no_lexicon(value):
    assert value(valence(F.lit("sehr good"), SMALL, boosters={"sehr": 0.5})).compound == pytest.approx(2.4 / math.sqrt(2.4**2 + 15))
    assert value(valence(F.lit("kein good"), SMALL, negations=["kein"])).compound < 0
    assert value(valence(F.lit("good"), {})).compound == 0


def test_rules_do_not_run_as_interpreted_lambdas(spark):
    """Expressions in lambdas cost microseconds a word; the rules are one function over batches, whatever the columns asked for."""
    frame = spark.createDataFrame([(1, "not good")], "id int, text string")
    shown = valence_score(frame, "id", "text", LEXICON)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("ArrowEvalPython") == 1 and "lambdafunction" not in shown


def test_many_texts_in_a_batch_with_words_forgotten(spark, monkeypatch):
    """A batch is more than the texts held at a time, and the words known may be forgotten between texts."""
    from tidemark.functions import valence as rules

    monkeypatch.setattr(rules, "CACHED_WORDS", 3)
    words = rules._known_words(LEXICON, BOOSTERS, NEGATIONS)
    texts = [f"a{i} very GOOD, isn't b{i} bad" for i in range(20)]
    assert [rules._scored(t, words(t.split())) for t in texts] == [pytest.approx(plain(t, LEXICON)) for t in texts]
    frame = spark.createDataFrame([(i, f"n{i} not good but bad!") for i in range(1000)], "id int, text string").coalesce(1)
    for row in valence_score(frame, "id", "text", LEXICON).collect():
        assert tuple(row)[1:] == pytest.approx(plain("n not good but bad!", LEXICON))
