"""Word pieces against greedy matching and the tokenizers library."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import sentiment, wordpiece
from tidemark.operators.wordpiece import Pieces, basic_words

tokenizers = pytest.importorskip("tokenizers")


def greedy(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


def library(vocabulary, lower=True):
    tokens = {"[UNK]": 0} | {t: i + 1 for i, t in enumerate(sorted(set(vocabulary) - {"[UNK]"}))}
    made = tokenizers.Tokenizer(tokenizers.models.WordPiece(tokens, unk_token="[UNK]", max_input_chars_per_word=100))
    made.normalizer = tokenizers.normalizers.BertNormalizer(lowercase=lower)
    made.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    return made


PIECE = st.text("abc", min_size=1, max_size=5)


@settings(max_examples=1500, deadline=None)
@given(st.sets(st.one_of(PIECE, PIECE.map(lambda p: "##" + p)), max_size=14), st.lists(st.text("abcd#", min_size=1, max_size=14), max_size=5))
def test_matches_greedily(vocabulary, words):
    pieces = Pieces(vocabulary)
    for word in words:
        assert pieces.match(word) == greedy(word, vocabulary)


def test_long_near_matches_take_linear_time():
    """A token that nearly fits everywhere makes greedy matching read the word again from every place."""
    pieces = Pieces(["a", "##a", "a" * 3000 + "b", "##" + "a" * 3000 + "b"], longest=10**9)
    started = time.time()
    assert pieces.match("a" * 200_000) == ["a"] + ["##a"] * 199_999
    assert time.time() - started < 5
    assert pieces.match("a" * 10 + "x") == ["[UNK]"] and Pieces(["a", "##a"]).match("a" * 101) == ["[UNK]"]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}


def vocabulary_of(texts):
    words = sorted({w for t in texts for w in basic_words(t or "")})
    chars = {c for w in words for c in w if c not in "zβ"}
    return sorted(chars | {"##" + c for c in chars} | set(words[::7]) | {"##" + w[-3:] for w in words[::11]} | {w[:4] for w in words[::5]})


@pytest.mark.parametrize("lower", [True, False])
def test_all_documents_like_the_library(documents, lower):
    vocabulary = vocabulary_of(documents.values())
    made, own = library(vocabulary, lower), Pieces(vocabulary, lower=lower)
    for text in documents.values():
        assert own.cut(text or "") == made.encode(text or "", add_special_tokens=False).tokens


@pytest.mark.parametrize("text", ["", " \t\n", "Ça va, naïve?", "İstanbul ÅNGSTRÖM ẛ̣", "東京都 is 首都", "a\x00b�c​d", "x_y-z…«q»", "1 2　3", "éé", "A+B=C $5 ^~`|"])
@pytest.mark.parametrize("lower", [True, False])
def test_odd_texts_like_the_library(text, lower):
    vocabulary = vocabulary_of([text, text.lower(), "abcdefghijklmnopqrstuvwxyz"])
    assert Pieces(vocabulary, lower=lower).cut(text) == library(vocabulary, lower).encode(text, add_special_tokens=False).tokens


def test_chunks_by_pieces(spark):
    vocabulary = spark.createDataFrame([(t,) for t in ("un", "##able", "##a", "do", "##able", None, "")], "token string")
    rows = [(1, "unable do unable"), (2, None), (3, ""), (4, "do q do"), (None, "do"), (1, "doable")]
    got = wordpiece.wordpiece_chunks(spark.createDataFrame(rows, "id int, body string"), "id", "body", vocabulary, 3, 1)
    assert got.columns == ["id", "chunk_no", "n_pieces", "chunk"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted([(1, 0, 3, "unable do"), (1, 1, 3, "do unable"), (1, 2, 1, "##able"), (4, 0, 3, "do do"), (4, 1, 1, "do"), (None, 0, 1, "do"), (1, 0, 2, "doable")], key=str)
    assert wordpiece.wordpiece_chunks(spark.createDataFrame(rows, "id int, body string").limit(0), "id", "body", vocabulary).collect() == []
    unknown = wordpiece.wordpiece_chunks(spark.createDataFrame([(1, "do")], "key int, text string"), "key", "text", vocabulary.limit(0)).first()
    assert tuple(unknown) == (1, 0, 1, "")
    with pytest.raises(ValueError, match="overlap"):
        wordpiece.wordpiece_chunks(spark.createDataFrame(rows, "id int, body string"), "id", "body", vocabulary, 3, 3)


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(wordpiece, "MAX_VOCABULARY", 2)
    with pytest.raises(ValueError, match="3 tokens"):
        wordpiece.vocabulary_tokens(spark.createDataFrame([("a",), ("b",), ("c",)], "token string"))


def test_model_scorer_takes_the_same_chunks(spark):
    pieces = Pieces(["do", "##able"])

    def load():
        return lambda texts: [("Positive" if t == "doable" else "Negative", 1.0) for t in texts]

    scorer = sentiment.model_scorer(load, 2, 0, pieces.cut, pieces.glue)
    frame = spark.createDataFrame([("doable doable do",)], "Text string")
    row = sentiment.score_snippets(frame, scorer).first()
    assert (row.Sentiment, row.Score) == ("Positive", 1)
