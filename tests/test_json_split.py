"""Arrays read in ranges against Python's parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.sources.json_split import array_elements


@pytest.fixture
def ranges(spark):
    """Sets the size of a range for a test."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def size(number):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(number))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    for k, v in before.items():
        spark.conf.set(k, v)


def value(draw, depth=0):
    kind = draw.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(draw.choices(['"', "\\", "{", "}", "[", "]", ",", "a", "é", "数", "\n", " ", '"articles": ['], k=draw.randint(0, 12)))
    if kind < 5:
        return draw.choice([None, True, 7, -1.5e9])
    if kind < 7:
        return {f"k{i}{draw.choice('{}[],')}": value(draw, depth + 1) for i in range(draw.randint(0, 4))}
    return [value(draw, depth + 1) for _ in range(draw.randint(0, 4))]


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def read(spark, folder):
    found = {}
    for r in array_elements(spark, str(folder), "*.json").collect():
        assert found.setdefault(r.path.rsplit("/", 1)[1], {}).setdefault(r.idx, r) is r
    return found


@pytest.mark.parametrize("size", [64, 700, 10**7])
def test_any_elements_in_any_ranges(spark, tmp_path, ranges, size):
    draw = random.Random(size)
    lists = {f"f{i}.json": [value(draw) for _ in range(draw.randint(1, 25))] for i in range(8)}
    for i, (name, items) in enumerate(lists.items()):
        whole = {"count": 3, "articles": items, "after": [1, 2, [3]]} if i % 2 else items
        put(tmp_path, name, json.dumps(whole, ensure_ascii=i % 3 == 0, indent=(None, 2)[i % 4 // 2]))
    put(tmp_path, "long.json", json.dumps([{"t": "x}" * 400}, "y" * 900, {"z": ["{"] * 300}]))
    lists["long.json"] = [{"t": "x}" * 400}, "y" * 900, {"z": ["{"] * 300}]
    ranges(size)
    found = read(spark, tmp_path)
    assert set(found) == set(lists)
    for name, items in lists.items():
        assert sorted(found[name]) == list(range(len(items))), name
        assert [json.loads(found[name][i].record) for i in range(len(items))] == items, name


def test_hundred_ranges_like_whole_files(spark, tmp_path, ranges):
    draw = random.Random(3)
    odd = lambda: "".join(draw.choices(['"', "\\", "{", "}", "[", "],", "a", "é"], k=9))
    comments = [{"time": "2024-01-02", "content": [{"text": f"t{i} {odd()}"}], "replies": [], "best_score": i} for i in range(400)]
    text = json.dumps(comments)
    put(tmp_path / "BTC", "a_comments.json", text)
    whole = sorted((r.idx, r.record) for r in files.json_records(files._whole_files(spark, f"{tmp_path}/*", "*_comments.json")).collect())
    ranges(len(text) // 100)
    split = array_elements(spark, f"{tmp_path}/*", "*_comments.json")
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/*").select(F.col("_metadata.file_block_start")).distinct().count() >= 100
    assert sorted((r.idx, r.record) for r in split.collect()) == whole and len(whole) == len(comments) > 100


@pytest.mark.parametrize("size", [16, 10**6])
def test_broken_files(spark, tmp_path, ranges, size):
    texts = {
        "empty.json": "[]", "blank.json": " [ \n ] ", "object.json": '{"a": [1, 2]}', "nothing.json": "", "cut.json": '[{"a": 1}, {"b": "x',
        "tail.json": '[1, 2] trailing, [3, 4]', "bom.json": '﻿[1, {"a": "é"}]', "comma.json": "[1,]", "bad.json": '[1, {"a" 2}, 3]', "open.json": "[1, 2",
    }
    for name, text in texts.items():
        put(tmp_path, name, text)
    ranges(size)
    found = {n: [(i, r.record, r.error) for i, r in sorted(rows.items(), key=str)] for n, rows in read(spark, tmp_path).items()}
    assert found == {
        "object.json": [(None, None, "no array")], "cut.json": [(0, '{"a": 1}', None), (1, None, "unreadable")],
        "tail.json": [(0, "1", None), (1, "2", None)], "bom.json": [(0, "1", None), (1, '{"a": "é"}', None)],
        "comma.json": [(0, "1", None), (1, None, "unreadable")], "bad.json": [(0, "1", None), (1, None, "unreadable"), (2, "3", None)],
        "open.json": [(0, "1", None), (1, None, "unreadable")],
    }
