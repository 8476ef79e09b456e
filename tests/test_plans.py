"""What the plans must not contain, and what the scans must."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import text as words_of
from tidemark.plans import social
from tidemark.plans.tables import Tables
from tidemark.session import spread_evenly

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(entry.__file__).parent / "tidemark"
WRITES = {"universe_scan", "bars_scan", "comments_scan", "master_publish", "category_scan", "comment_days_scan", "daily_sentiment_stream", "master_stream"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - WRITES))
def test_no_cross_joins_or_global_windows(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    if name not in ("backtest_folds", "fold_membership"):  # there the nested side is the list of folds
        assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window (?!Group)[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition", text)


@pytest.mark.parametrize("name", ["listing_fields", "listing_profile", "screener_rows", "detail_fields", "found_failed", "table_records"])
def test_pages_of_one_small_file_are_parsed_by_many_tasks(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert re.search(r"MapInArrow.*REPARTITION_BY_NUM", text, re.DOTALL) and "Exchange RoundRobin" in text


def test_memory_of_sketches_follows_a_bounded_number_of_rows(spark):
    """More rows make more tasks, and no value is sent to the task of its column's name."""
    assert [spread_evenly(spark.range(n), 100).rdd.getNumPartitions() for n in (0, 90, 5000)] == [8, 8, 50]
    assert spread_evenly(spark.range(5000), 100).distinct().count() == 5000
    text = plan(entry.queries()["sketch_profile"](spark, FOLDER))
    assert text.count("Exchange RoundRobin") == 3 and "BroadcastHashJoin [column" in text


def test_texts_are_cleaned_once(spark):
    """A text's words come from one evaluation of it, a vocabulary from one pass (the total stands in the plan too, with the same exchange)."""
    words = words_of.tokens(words_of.clean_social(F.col("text")))
    documents = Tables(spark, FOLDER).documents
    assert plan(documents.select(words.alias("w"))).count("http[^") == 1
    vocabulary = social.piece_vocabulary(Tables(spark, FOLDER))
    assert plan(vocabulary).count("FileScan") <= 3
    assert spark.createDataFrame([("a b",), ("",), (None,)], "c string").select(words_of.tokens(F.col("c")).alias("w")).collect() == [(["a", "b"],), ([],), (None,)]


def test_term_counts_are_shuffled_once(spark):
    """Every branch sums the same columns by term, the total too; one that sums fewer would be a shuffle of its own."""
    shown = plan(entry.queries()["tfidf_top_terms"](spark, FOLDER))
    assert re.search(r"keys=\[term#\d+\], functions=\[partial_count", shown)
    assert not re.search(r"keys=\[term#\d+\], functions=\[partial_sum", shown)


def test_library_collects_nothing():
    for file in PACKAGE.rglob("*.py"):
        if "llm" in file.relative_to(PACKAGE).parts:  # the training-data operators have a test of their own
            continue
        source = file.read_text()
        for banned in (".collect()", "toPandas", "localCheckpoint", "crossJoin", ".toLocalIterator"):
            assert banned not in source, (file, banned)


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["coverage_profile"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    text = plan(entry.queries()["date_range_filter"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in text and "LessThan" in text


def test_chunking_cleans_a_text_once(spark):
    """A plan that repeats the cleaning inside the chunk lambda costs one cleaning per chunk."""
    text = plan(entry.queries()["text_chunks"](spark, FOLDER))
    lambda_parts = re.findall(r"lambdafunction\((.*)", text)
    assert lambda_parts and not any("slice(" in p and "regexp_replace" in p.split("slice(")[1] for p in lambda_parts)


def test_scratch_space_is_the_shared_folder(spark):
    from tidemark.session import parameter_frame, shared_dir

    one, two = (shared_dir(spark, "x") for _ in range(2))
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(ValueError, match="parameter rows"):
        parameter_frame(spark, ((i,) for i in range(10_001)), "i int")
