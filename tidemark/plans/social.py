"""Prices, comments and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.numbers import polarity
from tidemark.operators import bars as bars_ops
from tidemark.operators import comments as comment_ops
from tidemark.operators import master as master_ops
from tidemark.operators import sentiment as sent
from tidemark.operators import wordpiece
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables, with_entities
from tidemark.schemas import RAW_COMMENT

# Classes of the text rules, spelled out once more for the SQL side.
S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WD = r"\p{L}\p{N}_"

# Weights of words that the test texts hold; the same list stands in both engines.
TEST_LEXICON = {w: 1.0 for w in ("the", "and", "la", "und", "is", "que", "les", "it")} | {
    w: -1.0 for w in ("of", "de", "der", "to", "en", "die", "for", "un")
}
UP = ", ".join(f"'{w}'" for w, v in TEST_LEXICON.items() if v > 0)
DOWN = ", ".join(f"'{w}'" for w, v in TEST_LEXICON.items() if v < 0)


def social_sql(column: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), "
        f"'http[^{S}]+', '', 'g'), '[^a-zA-Z0-9{S}]', '', 'g'), '[{S}]+', ' ', 'g'))"
    )


def news_sql(column: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({column}, "
        f"'http[^{S}]+', '', 'g'), '[^{WD}{S}]', '', 'g'), '[{S}]+', ' ', 'g'))"
    )


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^[{S}]+|[{S}]+$', '', 'g')"


def verdicts_sql(source: str, key: str, clean: str) -> str:
    """CTEs ``chunks`` and ``verdicts``: one row per chunk with label and score."""
    return f"""
    words AS (SELECT {key}, list_filter(string_split({clean}, ' '), lambda w: w <> '') AS w FROM {source}),
    starts AS (SELECT {key}, w, unnest(CASE WHEN len(w) > 0 THEN range(0, len(w), 462) ELSE [] END) AS s FROM words),
    chunks AS (SELECT {key}, CAST(s // 462 AS INTEGER) AS chunk_no, w[s + 1 : s + 512] AS c FROM starts),
    counted AS (SELECT {key}, chunk_no,
       len(list_filter(c, lambda x: lower(x) IN ({UP}))) AS up,
       len(list_filter(c, lambda x: lower(x) IN ({DOWN}))) AS down FROM chunks),
    verdicts AS (SELECT {key}, chunk_no,
       CASE WHEN up > down THEN 'Positive' WHEN down > up THEN 'Negative' ELSE 'Neutral' END AS label,
       CASE WHEN up + down = 0 THEN 0.5 ELSE CAST(greatest(up, down) AS DOUBLE) / (up + down) END AS score
       FROM counted)"""


# -- prices -----------------------------------------------------------------------------------


@query("bars_canonical", with_entities("""
SELECT CAST(Date AS VARCHAR) AS "Date", Ticker, Open, High, Low, Close, Close AS "Adj Close",
       Volume FROM bars""", "bars"))
def bars_canonical(t: Tables):
    return bars_ops.canonical_bars(t.bars.withColumn("Adj Close", F.col("Close")))


@query("fwd_return", with_entities("""
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, Close,
       round(lead(Close, 7) OVER (PARTITION BY Ticker ORDER BY Date) / Close - 1, 6) AS FwdRet_7d
FROM bars_long""", "bars_long"))
def fwd_return(t: Tables):
    out = bars_ops.forward_return(t.bars_long.select("Ticker", "Date", "Close"))
    return out.withColumn("FwdRet_7d", F.round("FwdRet_7d", 6))


@query("lookback", with_entities("""
, numbered AS (SELECT Ticker, Date, list(Close) OVER w AS h
  FROM bars_long WINDOW w AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, h[1] AS oldest, h[30] AS newest, CAST(len(h) AS INTEGER) AS n,
       round(list_sum(h) / 30, 3) AS mean
FROM numbered WHERE len(h) = 30""", "bars_long"))
def lookback(t: Tables):
    out = bars_ops.lookback(t.bars_long, "Close")
    h = F.col("history")
    total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "Ticker", "Date", h[0].alias("oldest"), h[29].alias("newest"), F.size(h).alias("n"),
        F.round(total / 30, 3).alias("mean"),
    )


# -- text rules -------------------------------------------------------------------------------


@query("clean_ascii", f"SELECT doc_id, {social_sql('text')} AS clean FROM documents")
def clean_ascii(t: Tables):
    return t.documents.select("doc_id", text.clean_social(F.col("text")).alias("clean"))


@query("clean_unicode", f"SELECT doc_id, {news_sql('text')} AS clean FROM documents")
def clean_unicode(t: Tables):
    return t.documents.select("doc_id", text.clean_news(F.col("text")).alias("clean"))


def forum_sql(column: str) -> str:
    plain = column
    for letter, pair in (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")):
        plain = f"replace({plain}, '{letter}', '{pair}')"
    plain = f"translate({plain}, '{text.ACCENTED}', '{text.PLAIN}')"
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({plain}, "
        f"'(?:http|www|https)[^{S}]+', '', 'g'), '[^{WD}{S},.!?]', '', 'g'), '[{S}]+', ' ', 'g'))"
    )


@query("clean_reddit", f"SELECT doc_id, {forum_sql('text')} AS clean FROM documents")
def clean_reddit(t: Tables):
    return t.documents.select("doc_id", text.clean_forum(F.col("text")).alias("clean"))


@query("strip_tags", f"""
SELECT page_id, {strip_sql("regexp_replace(html, '<[^>]*>', '', 'g')")} AS plain FROM pages""")
def strip_tags(t: Tables):
    return t.pages.select("page_id", text.strip_tags(F.col("html")).alias("plain"))


_NOTICE = "'We are having trouble retrieving the article content. Please Subscribe . '"


@query("strip_boilerplate", f"""
SELECT doc_id, {strip_sql(f"regexp_replace(concat(lang, ': ', {_NOTICE}, text), '(?is)We are having trouble retrieving.*?Subscribe[{S}]*[.]', '', 'g')")} AS body
FROM documents""")
def strip_boilerplate(t: Tables):
    """The paywall notice is put into every text, since the test texts hold none."""
    noted = F.concat("lang", F.lit(": "), F.lit(_NOTICE.strip("'")), "text")
    return t.documents.select("doc_id", text.strip_paywall(noted).alias("body"))


@query("text_chunks", f"""
WITH {verdicts_sql('documents', 'doc_id', social_sql('text'))}
SELECT doc_id, chunk_no, CAST(len(c) AS INTEGER) AS n_tokens, array_to_string(c, ' ') AS chunk FROM chunks""")
def text_chunks(t: Tables):
    words = text.tokens(text.clean_social(F.col("text")))
    rows = t.documents.select("doc_id", F.posexplode(text.chunk_arrays(words)).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", F.size("c").alias("n_tokens"), F.array_join("c", " ").alias("chunk"))


# A vocabulary from the texts themselves: letters (but x and 7), words and endings that make up a fixed share of all words, so that
# their number is bounded whatever the data.
_PIECES = """
words AS (SELECT doc_id, unnest(list_filter(string_split(lower({clean}), ' '), lambda w: w <> '')) AS word FROM documents),
uses AS (SELECT word, count(*) AS n FROM words GROUP BY word),
letters AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM uses),
endings AS (SELECT right(word, 3) AS e, sum(n) AS n FROM uses WHERE length(word) >= 4 GROUP BY 1),
vocabulary AS (SELECT c AS token FROM letters WHERE c NOT IN ('x', '7') UNION SELECT '##' || c FROM letters WHERE c NOT IN ('x', '7')
  UNION SELECT word FROM uses WHERE n * 5000 > (SELECT sum(n) FROM uses) UNION SELECT '##' || e FROM endings WHERE n * 1000 > (SELECT sum(n) FROM uses)),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM uses WHERE length(word) <= 100),
spans AS (SELECT word, pos, unnest(range(1, least(length(word) - pos + 2, 25))) AS len FROM places),
best AS (SELECT word, pos, max(len) AS len FROM spans JOIN vocabulary ON token = CASE WHEN pos = 1 THEN '' ELSE '##' END || substr(word, pos, len) GROUP BY word, pos),
walk AS (SELECT word, CAST(1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS p FROM uses
  UNION ALL SELECT w.word, w.pos + b.len, list_append(p, CASE WHEN w.pos = 1 THEN '' ELSE '##' END || substr(w.word, w.pos, b.len))
  FROM walk w JOIN best b ON b.word = w.word AND b.pos = w.pos),
cut AS (SELECT word, coalesce(max(p) FILTER (pos = length(word) + 1), ['[UNK]']) AS p FROM walk GROUP BY word),
numbered AS (SELECT doc_id, row_number() OVER () AS i, word FROM words),
texts AS (SELECT doc_id, flatten(list(p ORDER BY i)) AS p FROM numbered JOIN cut USING (word) GROUP BY doc_id),
chunks AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(p) / 462.0) AS BIGINT))) AS chunk_no, p FROM texts)"""


def piece_vocabulary(t: Tables):
    """Letters, frequent words and frequent endings of the cleaned texts, all out of one pass over them."""
    words = t.documents.select(F.explode(text.tokens(F.lower(text.clean_social(F.col("text"))))).alias("word"))
    uses = words.groupBy("word").agg(F.count("*").alias("n"))
    part = lambda kind, token: F.struct(F.lit(kind).alias("kind"), token.alias("token"))
    letters = F.transform(F.array_distinct(F.split("word", "")), lambda c: part("letter", c))
    ending = F.when(F.length("word") >= 4, F.array(part("ending", F.right("word", F.lit(3)))))
    parts = F.concat(F.array(part("word", F.col("word"))), F.coalesce(ending, F.array().cast("array<struct<kind: string, token: string>>")), letters)
    found = uses.select("n", F.inline(parts)).groupBy("kind", "token").agg(F.sum("n").alias("n"))
    # The total reads all columns of the counts too, so that Spark computes them once.
    total = found.agg(F.sum(F.when(F.col("kind") == "word", F.col("n")))).scalar()
    often = F.col("n") * F.when(F.col("kind") == "word", 5000).when(F.col("kind") == "ending", 1000) > total
    usual = (F.col("kind") == "letter") & ~F.col("token").isin("", "x", "7")
    tokens = (
        F.when(usual, F.array("token", F.concat(F.lit("##"), "token")))
        .when((F.col("kind") == "word") & often, F.array("token"))
        .when((F.col("kind") == "ending") & often, F.array(F.concat(F.lit("##"), "token")))
    )
    return found.select(F.explode(tokens).alias("token"))


@query("wordpiece_chunks", f"""
WITH RECURSIVE {_PIECES.format(clean=social_sql('text'))}
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(p[chunk_no * 462 + 1:chunk_no * 462 + 512]) AS INTEGER) AS n_pieces,
  replace(array_to_string(list_filter(p[chunk_no * 462 + 1:chunk_no * 462 + 512], lambda x: x <> '[UNK]'), ' '), ' ##', '') AS chunk FROM chunks""")
def wordpiece_chunks(t: Tables):
    rows = t.documents.select("doc_id", text.clean_social(F.col("text")).alias("clean"))
    return wordpiece.wordpiece_chunks(rows, "doc_id", "clean", piece_vocabulary(t))


# -- sentiment --------------------------------------------------------------------------------


@query("text_polarity", f"""
WITH {verdicts_sql('documents', 'doc_id', social_sql('text'))},
votes AS (SELECT doc_id, count(*) FILTER (label = 'Positive') AS p, count(*) FILTER (label = 'Neutral') AS u,
          count(*) FILTER (label = 'Negative') AS n, avg(score) AS conf FROM verdicts GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(p, 0) >= coalesce(greatest(u, n), 0) THEN 'Positive'
                      WHEN u >= n THEN 'Neutral' ELSE 'Negative' END AS Sentiment,
       CAST(coalesce(p - n, 0) AS BIGINT) AS Score, round(coalesce(conf, 0), 6) AS Confidence
FROM documents d LEFT JOIN votes v ON d.doc_id = v.doc_id""")
def text_polarity(t: Tables):
    texts = t.documents.select("doc_id", F.col("text").alias("Text"))
    scored = sent.score_snippets(texts, sent.lexicon_scorer(TEST_LEXICON))
    return scored.select(
        "doc_id", "Sentiment", F.col("Score").cast("bigint").alias("Score"),
        F.round("Confidence", 6).alias("Confidence"),
    )


SOCIAL_DAILY = """
daily AS (SELECT Ticker, Date, sum(CASE Sentiment WHEN 'Positive' THEN 1 WHEN 'Negative' THEN -1 ELSE 0 END) AS cum,
                 avg(Confidence) AS conf, count(Text) AS n FROM scored_snippets GROUP BY Ticker, Date)"""


def labelled_days(t: Tables):
    scored = t.scored_snippets.withColumn("Score", polarity(F.col("Sentiment")))
    return sent.daily_sentiment(scored)


def _rounded(frame, *names: str):
    return frame.withColumns({n: F.round(n, 6) for n in names})


@query("daily_sentiment", with_entities(f"""
, {SOCIAL_DAILY} SELECT Ticker, CAST(Date AS VARCHAR) AS Date, CAST(cum AS BIGINT) AS Sent_CumScore,
  round(conf, 6) AS Sent_Confidence, n AS Sent_TextCount, round(cum / n, 6) AS Sent_NormScore FROM daily""",
    "scored_snippets"))
def daily_sentiment(t: Tables):
    return _rounded(labelled_days(t), "Sent_Confidence", "Sent_NormScore")


@query("master_sentiment", with_entities(f"""
, {SOCIAL_DAILY} SELECT b.Ticker, CAST(b.Date AS VARCHAR) AS Date, Open, High, Low, Close, Volume,
  CAST(cum AS BIGINT) AS Sent_CumScore, round(conf, 6) AS Sent_Confidence, n AS Sent_TextCount,
  round(cum / n, 6) AS Sent_NormScore
FROM bars b LEFT JOIN daily d ON b.Ticker = d.Ticker AND b.Date = d.Date
WHERE b.Ticker IN (SELECT Ticker FROM daily)""", "bars", "scored_snippets"))
def master_sentiment(t: Tables):
    return _rounded(master_ops.master_with_sentiment(t.bars, labelled_days(t)), "Sent_Confidence", "Sent_NormScore")


@query("comment_sentiment", with_entities(f"""
, {verdicts_sql('comment_rows', 'conv_id, turn', social_sql('Text'))},
per_text AS (SELECT conv_id, turn, count(*) FILTER (label = 'Positive') - count(*) FILTER (label = 'Negative') AS s,
             avg(score) AS conf FROM verdicts GROUP BY conv_id, turn)
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, CAST(sum(coalesce(s, 0)) AS BIGINT) AS Sent_CumScore,
       round(avg(coalesce(conf, 0)), 6) AS Sent_Confidence, count(Text) AS Sent_TextCount,
       round(sum(coalesce(s, 0)) / count(Text), 6) AS Sent_NormScore
FROM comment_rows c LEFT JOIN per_text p ON c.conv_id = p.conv_id AND c.turn = p.turn
GROUP BY Ticker, Date""", "comment_rows"))
def comment_sentiment(t: Tables):
    """Raw comments to daily sentiment in one plan: clean, chunk, score, aggregate."""
    scored = sent.score_snippets(t.comment_rows, sent.lexicon_scorer(TEST_LEXICON))
    return _rounded(sent.daily_sentiment(scored), "Sent_Confidence", "Sent_NormScore")


# -- comments ---------------------------------------------------------------------------------


def raw_comments(t: Tables):
    """Conversation turns as crawled comments: the opening turn is content, others are replies in three shapes."""
    c = t.comment_rows
    body = F.col("Text")
    plain = F.struct(body.alias("text"))
    shaped = (
        F.when(F.col("turn") % 3 == 0, body)
        .when(F.col("turn") % 3 == 1, F.to_json(plain))
        .otherwise(F.to_json(F.struct(F.array(plain).alias("content"))))
    )
    opening = F.col("turn") == 0
    return c.select(
        "Ticker", "Date", "conv_id", "turn",
        F.when(opening, F.array(plain)).otherwise(F.array().cast("array<struct<text:string>>")).alias("content"),
        F.when(opening, F.array().cast("array<string>")).otherwise(F.array(shaped)).alias("replies"),
    )


@query("snippets", with_entities("""
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, Text, Type, 'Merged' AS Source FROM comment_rows
WHERE length(Text) > 0""", "comment_rows"))
def snippets(t: Tables):
    return comment_ops.comment_snippets(raw_comments(t))


@query("reply_flatten", f"""
WITH lines AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
nodes AS (SELECT conv_id, turn, l, unnest(range(0, len(l))) AS depth FROM lines)
SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS root_id,
       concat('0', repeat('.0', CAST(depth AS INTEGER))) AS path,
       CAST(depth AS INTEGER) AS depth, {strip_sql('l[depth + 1]')} AS text
FROM nodes""")
def reply_flatten(t: Tables):
    """Every line of a turn answers the line above it, so that trees get as deep as texts have lines."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    tree = F.aggregate(
        F.reverse(F.split("text", "\n")),
        F.lit(""),
        lambda below, line: F.concat(
            F.lit('{"content":[{"text":'), quoted(line), F.lit('}],"replies":['), below, F.lit("]}")
        ),
    )
    roots = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("root_id"), tree.alias("comment"))
    return comment_ops.flatten_replies(roots, "root_id", "comment")


@query("comment_project", """
SELECT event_id, strftime(to_timestamp(event_id * 8641) AT TIME ZONE 'UTC', '%Y-%m-%d') AS time,
       CAST(CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS BIGINT) AS ranks_up,
       CAST(0 AS BIGINT) AS ranks_down, event_type AS first_text, CAST(1 AS INTEGER) AS n_content,
       CAST(0 AS INTEGER) AS n_replies, CAST(event_id % 7 AS BIGINT) AS best_score,
       CAST(0 AS BIGINT) AS user_reputation, props AS additional_data
FROM events""")
def comment_project(t: Tables):
    """Events as crawled comments with gaps: odd ones lack a rank, all lack reputation and replies."""
    raw = F.to_json(F.struct(
        (F.col("event_id") * 8641).alias("time"),
        F.when(F.col("event_id") % 2 == 0, F.struct(F.col("user_id").alias("ranks_up"))).alias("rank"),
        F.array(F.struct(F.concat(F.lit(" <p>"), "event_type", F.lit("</p>\n")).alias("text"))).alias("content"),
        (F.col("event_id") % 7).alias("best_score"),
        F.parse_json("props").alias("additional_data"),
    ))
    parsed = t.events.select("event_id", F.from_json(raw, RAW_COMMENT).alias("c"))
    rows = parsed.select("event_id", "c.*").withColumnRenamed("event_id", "idx")
    out = comment_ops.project_comment(rows)
    return out.select(
        F.col("idx").alias("event_id"), "time", "rank.ranks_up", "rank.ranks_down",
        F.get("content", F.lit(0))["text"].alias("first_text"), F.size("content").alias("n_content"),
        F.size("replies").alias("n_replies"), "best_score", "user_reputation",
        F.replace("additional_data", F.lit(":"), F.lit(": ")).alias("additional_data"),
    )


@query("reddit_clean", f"""
WITH posts AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents),
cleaned AS (SELECT *, {forum_sql('lines[1]')} AS title,
  CAST(len(list_filter(lines, lambda x: {forum_sql('x')} <> '')) AS BIGINT) AS n FROM posts)
SELECT doc_id AS idx, CAST(DATE '1970-01-01' + CAST(doc_id AS INTEGER) AS VARCHAR) AS time, title,
       n AS replies_count, n AS total_replies_count, n_chars AS best_score, n_chars AS ranked_by_current_user,
       CAST(CASE WHEN lang = 'en' THEN 7 ELSE 0 END AS BIGINT) AS user_reputation
FROM cleaned""")
def reddit_clean(t: Tables):
    """Documents as forum submissions: the first line is the title, all lines come again as comments."""
    d = t.documents
    lines = F.split("text", "\n")
    posts = d.select(
        F.lit("forum").alias("Ticker"), F.col("doc_id").alias("idx"),
        (F.col("doc_id") * 86400 + 3599).alias("created"), lines[0].alias("title"), lines.alias("replies"),
        F.col("n_chars").alias("ups"), F.lit(0).cast("bigint").alias("downs"), F.col("n_chars").alias("score"),
        F.when(F.col("lang") == "en", 7).alias("karma"),
    )
    out = comment_ops.forum_comment(posts)
    return out.select(
        "idx", "time", F.get("content", F.lit(0))["text"].alias("title"), "replies_count",
        "total_replies_count", "best_score", "rank.ranked_by_current_user", "user_reputation",
    )


def _sources(t: Tables):
    """The same turns seen by two crawls, one of them with blanks around, and the labelled texts."""
    body = F.array(F.struct(F.col("Text").alias("text"))).alias("content")
    day = F.date_format("Date", "yyyy-MM-dd")
    turn = F.col("conv_id") * 100 + F.col("turn")
    one = t.comment_rows.select(
        "Ticker", day.alias("time"), F.lit("a_comments.json").alias("file"), turn.alias("idx"), body,
        F.lit("crawl").alias("source"),
    )
    again = t.comment_rows.select(
        "Ticker", day.alias("Date"), F.lit("b_comments.json").alias("file"), turn.alias("idx"),
        F.concat(F.lit(" "), "Text", F.lit("\n")).alias("text"),
    ).withColumn("content", F.lit(None).cast("array<struct<text:string>>"))
    texts = t.scored_snippets.select(
        "Ticker", day.alias("time"), F.lit("c_comments.json").alias("file"), F.col("text_id").alias("idx"), body
    )
    return [one, again, texts]


_MERGED = f"""
, sources AS (
  SELECT Ticker, Date, 'a_comments.json' AS file, conv_id * 100 + turn AS idx, {strip_sql('Text')} AS txt FROM comment_rows
  UNION ALL SELECT Ticker, Date, 'b_comments.json', conv_id * 100 + turn, {strip_sql('Text')} FROM comment_rows
  UNION ALL SELECT Ticker, Date, 'c_comments.json', text_id, {strip_sql('Text')} FROM scored_snippets),
kept AS (SELECT * FROM sources WHERE txt <> ''
  QUALIFY row_number() OVER (PARTITION BY Ticker, Date, txt ORDER BY file, idx) = 1)"""


@query("comments_merge", with_entities(f"""
{_MERGED} SELECT Ticker, CAST(Date AS VARCHAR) AS Date, file, idx, txt AS first_text FROM kept""",
    "comment_rows", "scored_snippets"))
def comments_merge(t: Tables):
    kept = comment_ops.merge_comments(_sources(t))
    first = text.strip_edges(comment_ops.representative_text(kept.columns))
    return kept.select("Ticker", "Date", "file", "idx", first.alias("first_text"))


@query("comment_days", with_entities(f"""
{_MERGED} SELECT Ticker, CAST(Date AS VARCHAR) AS Date, file, CAST(idx // 100 AS BIGINT) AS block,
  CAST(count(*) AS INTEGER) AS n, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS ids
FROM kept GROUP BY Ticker, Date, file, idx // 100""", "comment_rows", "scored_snippets"))
def comment_days(t: Tables):
    days = comment_ops.nest_by_day(comment_ops.merge_comments(_sources(t)), block=100)
    ids = F.array_join(F.transform("comments", lambda c: c["idx"].cast("string")), ",")
    return comment_ops.newest_days_first(days).select(
        "Ticker", "Date", "file", "block", F.size("comments").alias("n"), ids.alias("ids")
    )


@query("date_range_filter", """
SELECT event_id, event_type, 'midnight' AS end_rule FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT event_id, event_type, 'whole day' FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00'""")
def date_range_filter(t: Tables):
    parts = [
        comment_ops.within_range(t.events, "ts", "2024-01-05", "2024-01-20", whole_end_day=whole)
        .select("event_id", "event_type", F.lit(name).alias("end_rule"))
        for whole, name in ((False, "midnight"), (True, "whole day"))
    ]
    return parts[0].unionByName(parts[1])


@query("coverage_profile", """
SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS comments FROM events GROUP BY event_type""")
def coverage_profile(t: Tables):
    out = comment_ops.time_coverage(t.events, ["event_type"], "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("oldest", "newest")})


@query("epoch_to_date", """
SELECT o_orderkey, CAST(DATE '1970-01-01' + CAST((800000000 + o_orderkey * 7919) // 86400 AS INTEGER) AS VARCHAR) AS day,
       CAST(epoch(o_orderdate) AS BIGINT) AS order_epoch FROM orders""")
def epoch_to_date(t: Tables):
    day = dates.epoch_day_text(F.lit(800000000) + F.col("o_orderkey") * 7919)
    return t.orders.select(
        "o_orderkey", day.alias("day"), dates.day_epoch(F.col("o_orderdate").cast("date")).alias("order_epoch")
    )


@query("topn_per_group", with_entities("""
, newest AS (SELECT * FROM submissions
  QUALIFY row_number() OVER (PARTITION BY Ticker, forum ORDER BY created DESC, id) <= 50)
SELECT Ticker, forum, id, created FROM newest WHERE created >= 800500000""", "submissions"))
def topn_per_group(t: Tables):
    """The cut to the newest comes first, the date filter after it."""
    newest = comment_ops.newest_per_group(
        t.submissions, ["Ticker", "forum"], [F.col("created").desc(), F.col("id")], comment_ops.NEWEST_PER_FORUM
    )
    return newest.where("created >= 800500000").select("Ticker", "forum", "id", "created")
