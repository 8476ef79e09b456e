"""The pipeline over a small corpus against the stages in plain Python, and the entry's guard."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_near_dedup import brute as brute_classes
from tests.llm.test_text_operators import base_spans, numbers
from tidemark.llm import quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(20)) + "." for _ in range(n))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    rows = [(i, text(5)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, rows[i][1] + " and more") for i in range(5, 15)]
    rows += [(300 + i, rows[20 + i][1] + "\n" + items[i][1]) for i in range(5)]
    rows += [(400 + i, text(4) + f'\ntoken = "{hashlib.sha1(bytes([i])).hexdigest()}"\n' + text(2)) for i in range(25)]
    rows += [(500, None), (501, ""), (502, "short"), (503, "same words " * 100), (504, " ".join(word() + "###" for _ in range(90))), (505, text(6).upper().replace(" ", "!! "))]
    path = tmp_path_factory.mktemp("tables")
    full = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_and_run(spark, folder):
    path, rows, items = folder
    documents = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(documents).where("kept").collect()}
    left = [(i, t) for i, t in rows if not numbers(t)[-1] and i in kept]
    assert not {500, 501, 502, 503, 504, 505} & {i for i, _ in left} and len(left) == len(rows) - 6
    first = {i for i, _, _, stays in brute_classes(left, 80) if stays}
    left = [(i, t) for i, t in left if i in first]
    hit = {i for i, *_, found in brute_windows(left, items) if found}
    left = [(i, t) for i, t in left if i not in hit]
    assert len(hit) == 5 and len(left) < len(rows) - 20

    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == documents.columns
    masked = {r.doc_id: r for r in docs.collect()}
    assert set(masked) == {i for i, _ in left}
    for i, t in left:
        assert not base_spans(masked[i].text) and masked[i].n_chars == len(masked[i].text)
        assert masked[i].text == t or ("[secret]" in masked[i].text and base_spans(t))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in out) == sorted(masked)
    for r in out:
        assert r.ids == library.encode(masked[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_library_does_not_need_the_subpackage(monkeypatch):
    import importlib

    for gone in ("tidemark.llm", "corpus_pipeline"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n == gone or n.startswith((gone + ".", "__spark_entry__"))]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, gone, None)
            m.delitem(sys.modules, "__spark_entry__", raising=False)
            if gone == "tidemark.llm":
                m.delitem(sys.modules, "corpus_pipeline", raising=False)
            entry = importlib.import_module("__spark_entry__")
            assert "master_sentiment" in entry.queries() and "pipeline" not in entry.queries()
            m.delitem(sys.modules, "__spark_entry__")
