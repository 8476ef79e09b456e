import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import comments as ops

ROW = "Ticker string, time string, file string, idx bigint, content array<struct<text string>>, replies array<string>"


def rows(spark, *items):
    return spark.createDataFrame([(*i[:4], [(i[4],)] if i[4] is not None else [], []) for i in items], ROW)


def test_first_copy_wins_per_day(spark):
    one = rows(
        spark,
        ("T", "2024-01-01", "b", 0, " x "), ("T", "2024-01-01", "a", 7, "x"), ("T", "2024-01-02", "b", 1, "x"),
        ("T", "2024-01-01", "a", 8, " "), ("T", None, "a", 9, "y"), ("U", "2024-01-01", "b", 2, "x"),
    )
    merged = ops.merge_comments([one.withColumn("source", F.lit("s"))])
    got = {(r.Ticker, r.Date.isoformat(), r.file, r.idx) for r in merged.collect()}
    assert got == {("T", "2024-01-01", "a", 7), ("T", "2024-01-02", "b", 1), ("U", "2024-01-01", "b", 2)}
    again = ops.merge_comments([merged.withColumn("time", F.col("Date").cast("string")).drop("Date")])
    assert again.count() == 3


def test_plain_text_field_and_date_alias(spark):
    old = spark.createDataFrame([("T", "2024-01-01", "a", 0, "hi")], "Ticker string, Date string, file string, idx bigint, text string")
    merged = ops.merge_comments([rows(spark, ("T", "2024-01-01", "b", 0, "hi")), old])
    assert [(r.file, r.text) for r in merged.collect()] == [("a", "hi")]


def test_copies_of_one_text_need_no_window(spark):
    plan = ops.merge_comments([rows(spark, ("T", "2024-01-01", "a", 0, "x"))])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_days_are_nested_in_bounded_blocks(spark):
    flat = spark.range(25).select(
        F.lit("T").alias("Ticker"), F.lit("2024-01-01").cast("date").alias("Date"), F.lit("f").alias("file"),
        F.col("id").alias("idx"), F.array(F.struct(F.col("id").cast("string").alias("text"))).alias("content"),
    )
    days = ops.newest_days_first(ops.nest_by_day(flat, block=10)).collect()
    assert [len(d.comments) for d in days] == [10, 10, 5]
    assert [c.idx for d in days for c in d.comments] == list(range(25))


def test_reply_shapes(spark):
    replies = ["hi", '{"text":"a"}', '{"content":[{"text":"b"},{"text":"c"}]}', "", '{"other":1}', "{not json", " "]
    frame = spark.createDataFrame(
        [("T", "d", [("main",), ("",)], replies)],
        "Ticker string, Date string, content array<struct<text string>>, replies array<string>",
    )
    got = [(r.Type, r.Text) for r in ops.comment_snippets(frame).collect()]
    assert sorted(got) == sorted(
        [("Main", "main"), ("Reply", "hi"), ("Reply", "a"), ("Reply", "b"), ("Reply", "c"), ("Reply", "{not json"), ("Reply", " ")]
    )


def tree(depth, width=1):
    return {
        "content": [{"text": f" <b>d{depth}</b> "}],
        "replies": [tree(depth - 1, width) for _ in range(width)] if depth else [],
    }


def walk(node, path="0", depth=0):
    yield path, depth, node["content"][0]["text"].replace("<b>", "").replace("</b>", "").strip()
    for i, r in enumerate(node["replies"]):
        yield from walk(r, f"{path}.{i}", depth + 1)


def test_reply_trees_of_any_depth(spark):
    root = tree(5, 2)
    frame = spark.createDataFrame([("k", json.dumps(root))], "id string, c string")
    got = {(r.path, r.depth, r.text) for r in ops.flatten_replies(frame, "id", "c").collect()}
    assert got == set(walk(root))


def test_replies_of_every_shape(spark):
    root = {"content": [{"text": "<i>a</i>"}, {}], "replies": ["plain <b>b</b>", {"text": "c", "replies": [{"content": [], "replies": ["d"]}]}, 7, {"content": 3}]}
    rows = [("k", json.dumps(root)), ("none", None), ("bad", "{"), ("deep", json.dumps(tree(60)))]
    frame = spark.createDataFrame(rows, "id string, c string")
    got = [(r.id, r.path, r.depth, r.text) for r in ops.flatten_replies(frame, "id", "c").collect() if r.id != "deep"]
    assert sorted(got) == [("k", "0", 0, ""), ("k", "0", 0, "a"), ("k", "0.0", 1, "plain b"), ("k", "0.1", 1, "c"), ("k", "0.1.0.0", 3, "d")]
    assert ops.flatten_replies(frame, "id", "c").where("id = 'deep'").count() == 61
    bad = [(r.id, r.path) for r in ops.unreadable_replies(frame, "id", "c").collect()]
    assert sorted(bad) == [("bad", "0"), ("k", "0.2"), ("k", "0.3")]


def test_range_ends_at_midnight(spark):
    frame = spark.sql(
        "SELECT explode(array(timestamp_ntz'2025-06-01 00:00:00', timestamp_ntz'2025-06-01 00:00:01', timestamp_ntz'2025-05-31 23:59:59')) AS t"
    )
    assert ops.within_range(frame, "t", "2025-05-31", "2025-06-01").count() == 2
    assert ops.within_range(frame, "t", "2025-05-31", "2025-06-01", whole_end_day=True).count() == 3


def test_projection_defaults(spark):
    raw = spark.createDataFrame(
        [(0, None, None, [(" <i>t</i>",), (None,)], None, None)],
        "time bigint, replies_count bigint, rank struct<ranks_up bigint, ranks_down bigint, ranked_by_current_user bigint>, "
        "content array<struct<text string>>, replies array<string>, additional_data string",
    ).withColumns({c: F.lit(None).cast("bigint") for c in ("best_score", "total_replies_count", "user_reputation")})
    row = ops.project_comment(raw).first()
    assert (row.time, row.replies_count, row.rank.ranks_up, row.replies, row.additional_data) == ("1970-01-01", 0, 0, [], "{}")
    assert [c.text for c in row.content] == ["t", ""]


def test_forum_counts_only_filled_replies(spark):
    posts = spark.createDataFrame(
        [("T", 86400, "Tïtle!", ["ok", "http://x", "@"], 3, 1, 2, None)],
        "Ticker string, created bigint, title string, replies array<string>, ups bigint, downs bigint, score bigint, karma int",
    )
    row = ops.forum_comment(posts).first()
    assert (row.time, row.replies_count, row.user_reputation, row.best_score) == ("1970-01-02", 1, 0, 2)
    assert row.content[0].text == "Title!" and json.loads(row.replies[0]) == {"text": "ok"}


def test_newest_first_cut(spark):
    frame = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    top = ops.newest_per_group(frame, ["g"], [F.col("id").desc()], 3)
    assert {r.id for r in top.collect()} == {94, 95, 96, 97, 98, 99}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
