"""What the training-data operators may bring to the driver: aggregates of a stated size and limited rows, nothing else."""

import re
from pathlib import Path

import tidemark.llm
from tidemark.llm import decontaminate

# Files and how many of their collects are bounded by something other than a limit in the same statement: patterns of votes (4 to the power of
# the rules), labelled URLs of a documented sample and the shares of these.
BOUNDED = {"quality.py": 1, "url_filter.py": 2}


def test_collects_are_bounded():
    for file in Path(tidemark.llm.__file__).parent.glob("*.py"):
        source = file.read_text()
        for banned in ("toPandas", "localCheckpoint", "crossJoin", ".toLocalIterator"):
            assert banned not in source, (file, banned)
        lines = [line for line in source.splitlines() if ".collect()" in line]
        free = [line for line in lines if ".limit(" not in line]
        assert len(free) <= BOUNDED.get(file.name, 0), (file, free)


def test_blocks_hold_every_window_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    texts = {"a": " ".join(f"w{i}" for i in range(40)), "b": "x y", "c": "", "d": " ".join(f"v{i}" for i in range(10)), "e": "u " * 25}
    items = spark.createDataFrame(list(texts.items()), "item_id string, text string")
    for size in (1, 12, 10**6):
        blocks = list(decontaminate.test_blocks(items, 10, size))
        found = []
        for block in blocks:
            assert sum(len(words.split()) for _, words in block) <= max(size, 1) + 40
            windows = decontaminate._Windows(block, 10)
            words = {i: w for w, i in windows.numbers.items()}
            found += [(name, b" ".join(words[i] for i in row)) for matrix, names in windows.by_length.values() for row, name in zip(matrix.tolist(), names, strict=True)]
        want = []
        for name, text in texts.items():
            own = text.encode().split()
            want += [(name, b" ".join(own[i : i + 10])) for i in range(max(1, len(own) - 9) if own else 0)]
        assert sorted(found) == sorted(want)
    assert len(list(decontaminate.test_blocks(items, 10, 1))) > 3


def test_driver_sees_buckets_not_the_test_set():
    source = Path(decontaminate.__file__).read_text()
    assert len(re.findall(r"\.collect\(\)", source)) == 2
