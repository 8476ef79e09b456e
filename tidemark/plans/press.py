"""News, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, html, text
from tidemark.operators import keywords
from tidemark.operators import master as master_ops
from tidemark.operators import news as news_ops
from tidemark.operators import pages as page_ops
from tidemark.operators import sentiment as sent
from tidemark.plans.registry import query
from tidemark.plans.social import S, TEST_LEXICON, news_sql, strip_sql, verdicts_sql
from tidemark.plans.tables import Tables, with_entities
from tidemark.sources import files

# The default vocabulary hardly occurs in the test texts, so frequent words are added to it.
TEST_KEYWORDS = (*text.EVENT_KEYWORDS, "that", "für", "pour", "sich")
_ANY_KEYWORD = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(TEST_KEYWORDS) + ")([^\\p{L}\\p{N}_]|$)"

ARTICLE_TEXTS = """texts AS (SELECT *, concat(coalesce(Title, ''), ' ', coalesce(Summary, ''), ' ', coalesce(Body, '')) AS Text
  FROM articles)"""
NEWS_SCORED = f"""{ARTICLE_TEXTS}, {verdicts_sql('texts', 'article_id', news_sql('Text'))},
votes AS (SELECT article_id, count(*) FILTER (label = 'Positive') AS p, count(*) FILTER (label = 'Negative') AS n,
          sum(score) AS conf, count(*) AS chunks FROM verdicts GROUP BY article_id),
scored AS (SELECT a.article_id, Ticker, Date, CAST(coalesce(p - n, 0) AS DOUBLE) AS News_Score,
   coalesce(conf / greatest(p + n, 1), 0) AS News_Conf, coalesce(conf / chunks, 0) AS mean_conf
   FROM articles a LEFT JOIN votes v ON a.article_id = v.article_id)"""
NEWS_DAILY = """daily AS (SELECT Ticker, Date, sum(News_Score) AS News_Score, count(News_Score) AS News_Cnt,
   avg(News_Conf) AS News_Conf, sum(News_Score) / count(News_Score) AS News_Norm FROM scored GROUP BY Ticker, Date)"""
NEWS_FLAGS = f"""flags AS (SELECT Ticker, Date, max(CAST(regexp_matches(Text, '{_ANY_KEYWORD}') AS INTEGER)) AS Event_Flag
   FROM texts GROUP BY Ticker, Date)"""


def _rounded(frame, *names: str):
    return frame.withColumns({n: F.round(n, 6) for n in names})


def scored_articles(t: Tables):
    return news_ops.score_articles(t.articles, sent.lexicon_scorer(TEST_LEXICON))


def press_features(t: Tables):
    return news_ops.daily_features(t.articles, sent.lexicon_scorer(TEST_LEXICON), TEST_KEYWORDS)


# -- texts and events -------------------------------------------------------------------------


@query("article_text", with_entities(f", {ARTICLE_TEXTS} SELECT article_id, Text FROM texts", "articles"))
def article_text(t: Tables):
    return news_ops.full_text(t.articles).select("article_id", "Text")


@query("event_flag", with_entities(f"""
, {ARTICLE_TEXTS} SELECT article_id, CAST(regexp_matches(Text, '{_ANY_KEYWORD}') AS INTEGER) AS Event_Flag FROM texts""",
    "articles"))
def event_flag(t: Tables):
    flag = text.event_flag(F.col("Text"), TEST_KEYWORDS)
    return news_ops.full_text(t.articles).select("article_id", flag.alias("Event_Flag"))


@query("event_keyword_counts", with_entities(f"""
, {ARTICLE_TEXTS}, vocabulary AS (SELECT unnest([{', '.join(f"'{k}'" for k in TEST_KEYWORDS)}]) AS keyword)
SELECT Ticker, keyword, count(*) AS articles FROM texts JOIN vocabulary
  ON regexp_matches(Text, concat('(?i)(^|[^\\p{{L}}\\p{{N}}_])', keyword, '([^\\p{{L}}\\p{{N}}_]|$)'))
GROUP BY Ticker, keyword""", "articles"))
def event_keyword_counts(t: Tables):
    return news_ops.keyword_counts(t.articles, TEST_KEYWORDS)


@query("keyword_automaton", """
WITH vocabulary AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS keyword FROM benchmark),
usable AS (SELECT keyword FROM vocabulary WHERE regexp_full_match(keyword, '\\p{L}+') AND length(keyword) > 2),
words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS keyword FROM documents)
SELECT keyword, count(DISTINCT doc_id) AS texts, count(*) AS hits FROM words JOIN usable USING (keyword) GROUP BY keyword""")
def keyword_automaton(t: Tables):
    """Every word of the benchmark as a keyword of the documents."""
    vocabulary = t.benchmark.select(F.explode(F.split(F.lower("text"), f"[^{text.WORD}]+")).alias("keyword"))
    return keywords.hit_counts(keywords.keyword_hits(t.documents, "doc_id", "text", vocabulary), "doc_id")


@query("daily_event", with_entities(f"""
, {ARTICLE_TEXTS}, {NEWS_FLAGS} SELECT Ticker, CAST(Date AS VARCHAR) AS Date, Event_Flag FROM flags""", "articles"))
def daily_event(t: Tables):
    return news_ops.daily_events(t.articles, TEST_KEYWORDS)


@query("article_polarity", with_entities(f"""
, {NEWS_SCORED} SELECT article_id, News_Score, round(News_Conf, 6) AS News_Conf, round(mean_conf, 6) AS mean_conf
FROM scored""", "articles"))
def article_polarity(t: Tables):
    verdicts = sent.lexicon_scorer(TEST_LEXICON)(text.clean_news(F.col("Text")))
    scored = news_ops.full_text(t.articles).select("article_id", verdicts.alias("s"))
    scores = F.col("s")
    return scored.select(
        "article_id", sent.vote_balance(scores).cast("double").alias("News_Score"),
        F.round(sent.opinion_confidence(scores), 6).alias("News_Conf"),
        F.round(sent.mean_confidence(scores), 6).alias("mean_conf"),
    )


@query("daily_news", with_entities(f"""
, {NEWS_SCORED}, {NEWS_DAILY} SELECT Ticker, CAST(Date AS VARCHAR) AS Date, News_Score, News_Cnt,
  round(News_Conf, 6) AS News_Conf, round(News_Norm, 6) AS News_Norm FROM daily""", "articles"))
def daily_news(t: Tables):
    return _rounded(news_ops.daily_news(scored_articles(t)), "News_Conf", "News_Norm")


@query("master_refresh", with_entities(f"""
, {NEWS_SCORED}, {NEWS_DAILY}, {NEWS_FLAGS}
SELECT b.Ticker, CAST(b.Date AS VARCHAR) AS Date, Close, coalesce(News_Score, 0) AS News_Score,
  CAST(coalesce(News_Cnt, 0) AS BIGINT) AS News_Cnt, round(coalesce(News_Conf, 0), 6) AS News_Conf,
  round(coalesce(News_Norm, 0), 6) AS News_Norm, coalesce(Event_Flag, 0) AS Event_Flag
FROM bars b LEFT JOIN daily d ON b.Ticker = d.Ticker AND b.Date = d.Date
            LEFT JOIN flags f ON b.Ticker = f.Ticker AND b.Date = f.Date""", "bars", "articles"))
def master_refresh(t: Tables):
    """Refreshed twice over a master that holds stale columns: the second run changes nothing."""
    stale = t.bars.select("Ticker", "Date", "Close", F.lit(9.0).alias("News_Score"), F.lit(0.5).alias("FwdRet_7d"))
    news, events = news_ops.daily_news(scored_articles(t)), news_ops.daily_events(t.articles, TEST_KEYWORDS)
    once = master_ops.refresh_news(stale, news, events)
    return _rounded(master_ops.refresh_news(once, news, events), "News_Conf", "News_Norm")


@query("credible_news", with_entities("""
SELECT article_id, Ticker, CAST(Date AS VARCHAR) AS Date, p_cred FROM articles WHERE p_cred >= 0.6""", "articles"))
def credible_news(t: Tables):
    return news_ops.credible(t.articles).select("article_id", "Ticker", "Date", "p_cred")


# -- feeds ------------------------------------------------------------------------------------


def article_feeds(t: Tables):
    """One feed per article: bare lists and wrapped ones, in both field layouts."""
    a = t.articles
    day = F.date_format("Date", "yyyy-MM-dd")
    master = F.to_json(F.struct(day.alias("Date"), "Title", "Summary", F.array("Body").alias("Body")))
    search = F.to_json(F.struct(
        F.concat(day, F.lit("T23:30:00-0500")).alias("published_date"), F.col("Title").alias("headline"),
        F.col("Summary").alias("abstract"), F.col("Body").alias("body"),
    ))
    one = F.when(F.col("article_id") % 2 == 0, master).otherwise(search)
    feed = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit('{"articles":['), one, F.lit("]}"))).otherwise(
        F.concat(F.lit("["), one, F.lit("]"))
    )
    return a.select("Ticker", feed.alias("json"))


@query("articles_scan", with_entities("""
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, nullif(Title, '') AS Title, Summary, nullif(Body, '') AS Body
FROM articles""", "articles"))
def articles_scan(t: Tables):
    return files.parse_articles(article_feeds(t), "json")


def search_pages(t: Tables):
    """Landed search pages: the hits of a ticker, pass and page as one JSON response."""
    hit = F.struct(
        "pos", "web_url", "pub_date", "section_name", "news_desk", F.struct(F.col("headline").alias("main")).alias("headline"),
        "abstract", F.when(F.col("pos") % 2 == 0, F.col("abstract")).alias("snippet"),
    )
    pages = t.news_docs.groupBy("Ticker", "pass", "page").agg(F.sort_array(F.collect_list(hit)).alias("docs"))
    return pages.select("Ticker", "pass", "page", F.to_json(F.struct(F.struct("docs").alias("response"))).alias("json"))


@query("news_flatten", with_entities("""
SELECT Ticker, strftime(CAST(substr(pub_date, 1, 10) AS DATE), '%Y-%m-%d') AS Date, web_url AS URL,
       headline AS "News Title", abstract AS "News Abstract",
       CASE WHEN pos % 2 = 0 THEN abstract ELSE '' END AS "News Content" FROM news_docs""", "news_docs"))
def news_flatten(t: Tables):
    return news_ops.news_urls(files.parse_search_pages(search_pages(t), "json"))


@query("news_dedupe", with_entities("""
, first AS (SELECT * FROM news_docs WHERE pos < 10 AND coalesce(web_url, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY Ticker, web_url ORDER BY pass, page, pos) = 1),
named AS (SELECT *, CASE WHEN coalesce(section_name, '') <> '' THEN section_name ELSE news_desk END AS section FROM first)
SELECT Ticker, web_url AS url, section, headline, pass, page, pos FROM named
WHERE section IN ('Technology', 'Business')""", "news_docs"))
def news_dedupe(t: Tables):
    kept = news_ops.dedupe_articles(t.news_docs)
    return kept.select("Ticker", F.col("web_url").alias("url"), "section", "headline", "pass", "page", "pos")


@query("news_fallback", with_entities("""
, best AS (SELECT Ticker, min(pass) AS pass FROM news_docs GROUP BY Ticker)
SELECT n.Ticker, n.pass, page, pos, doc_id FROM news_docs n JOIN best b ON n.Ticker = b.Ticker AND n.pass = b.pass""",
    "news_docs"))
def news_fallback(t: Tables):
    return news_ops.first_pass_with_hits(t.news_docs).select("Ticker", "pass", "page", "pos", "doc_id")


@query("offset_date", with_entities("""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE substr(pub_date, 1, 10) END AS day FROM news_docs""", "news_docs"))
def offset_date(t: Tables):
    stamp = F.when(F.col("doc_id") % 10 != 0, F.col("pub_date"))
    return t.news_docs.select("doc_id", dates.offset_day(stamp).alias("day"))


@query("lenient_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day
FROM orders""")
def lenient_date(t: Tables):
    """Order dates written in five layouts and, every sixth, as something that is no date."""
    day = F.col("o_orderdate")
    shape = F.col("o_orderkey") % 6
    written = (
        F.when(shape == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-0500")))
        .when(shape == 2, F.date_format(day, "MM/dd/yyyy"))
        .when(shape == 3, F.date_format(day, "MMMM d, yyyy"))
        .when(shape == 4, F.date_format(day, "MM-dd-yyyy"))
        .otherwise(F.concat(F.lit("week "), F.date_format(day, "dd")))
    )
    return t.orders.select("o_orderkey", dates.lenient_day(written).alias("day"))


# -- pages ------------------------------------------------------------------------------------


@query("page_paragraphs", f"""
WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages),
paras AS (SELECT page_id, regexp_extract_all(h, '(?is)<p(?:[{S}][^>]*)?>(.*?)</p>', 1) AS ps FROM bare)
SELECT page_id, CAST(len(ps) AS INTEGER) AS n,
  array_to_string(list_transform(ps, lambda p: {strip_sql("regexp_replace(p, '<[^>]*>', '', 'g')")}), ' ') AS body
FROM paras""")
def page_paragraphs(t: Tables):
    found = html.flat_paragraphs(F.col("html"))
    return t.pages.select("page_id", F.size(found).alias("n"), F.array_join(found, " ").alias("body"))


@query("page_body", f"""
WITH events AS (SELECT page_id, unnest(es) AS e, unnest(range(1, len(es) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>|[^<]+') AS es FROM pages)),
levels AS (SELECT *, sum(CASE e WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM events),
opened AS (SELECT page_id, i, d FROM levels WHERE e = '<p>'),
spans AS (SELECT o.page_id, o.i, min(c.i) AS j FROM opened o
  LEFT JOIN levels c ON c.page_id = o.page_id AND c.i > o.i AND c.e = '</p>' AND c.d < o.d GROUP BY o.page_id, o.i),
texts AS (SELECT page_id, i, {strip_sql("regexp_replace(replace(e, '&quot;', chr(34)), '&amp;?', '&', 'g')")} AS t
  FROM events WHERE e NOT LIKE '<%'),
paragraphs AS (SELECT s.page_id, s.i, coalesce(string_agg(t, ' ' ORDER BY x.i), '') AS p FROM spans s
  LEFT JOIN texts x ON x.page_id = s.page_id AND x.i > s.i AND (s.j IS NULL OR x.i < s.j) AND t <> '' GROUP BY s.page_id, s.i)
SELECT page_id, 'article' AS rule, {strip_sql("string_agg(p, ' ' ORDER BY i)")} AS body FROM paragraphs GROUP BY page_id""")
def page_body(t: Tables):
    """Body text by the first rule that fires; unclosed paragraphs reach to the end of the article."""
    return page_ops.article_bodies(t.pages, "page_id", "html")


def rule_pages(t: Tables):
    """Documents as pages, one paragraph per line, in a container for each rule of the search."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n")
    paragraphs = lambda attrs="": F.array_join(
        F.transform(lines, lambda x: F.concat(F.lit(f"<p{attrs}>"), x, F.lit("</p>"))), ""
    )
    embedded = F.to_json(F.struct(F.struct(F.struct(paragraphs().alias("articleBody")).alias("article")).alias("props")))
    decoy = "<article><p>decoy</p></article>"
    wrap = lambda before, body, after: F.concat(F.lit(before), body, F.lit(after))
    variants = [
        wrap(f'{decoy}<section data-testid="article-body"><div>', paragraphs(), "</div></section>"),
        wrap(f'{decoy}<section id="article-body">', paragraphs(), "</section>"),
        wrap(f'{decoy}<section class="a meteredContent-x">', paragraphs(), "</section>"),
        wrap(f'{decoy}<section name="articleBody">', paragraphs(), "</section>"),
        wrap(f'{decoy}<div class="x css-1ab"><div>', paragraphs(), "</div></div>"),
        wrap(f"{decoy}<div>", paragraphs(' data-testid="paragraph"'), "</div>"),
        wrap(f'{decoy}<script id="__NEXT_DATA__" type="application/json">',
             F.replace(embedded, F.lit("</"), F.lit("<\\/")), "</script>"),
        wrap("<p>decoy</p><article><header>h</header>", paragraphs(), "</article>"),
        wrap("<p>decoy</p><main>", paragraphs(), "</main>"),
        wrap("<style>p{}</style><div>", paragraphs(), "<!-- <p>no</p> --></div>"),
    ]
    shape = F.col("doc_id") % len(variants)
    html_text = variants[-1]
    for i, v in enumerate(variants[:-1]):
        html_text = F.when(shape == i, v).otherwise(html_text)
    return t.documents.select("doc_id", html_text.alias("html"))


_RULES = (
    "section-testid", "section-id", "section-metered", "section-name", "styled-div", "marked-paragraphs",
    "embedded-json", "article", "main", "page",
)


@query("page_body_rules", f"""
WITH lines AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}) AS l FROM documents)
SELECT doc_id, [{', '.join(f"'{r}'" for r in _RULES)}][1 + doc_id % 10] AS rule,
  {strip_sql("array_to_string(CASE WHEN doc_id % 10 = 6 THEN list_filter(l, lambda x: x <> '') ELSE l END, ' ')")} AS body
FROM lines""")
def page_body_rules(t: Tables):
    return page_ops.article_bodies(rule_pages(t), "doc_id", "html")


@query("page_body_fallback", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'section-testid' ELSE 'rendered-article' END AS rule,
  {strip_sql("array_to_string(list_transform(string_split(text, chr(10)), lambda x: " + strip_sql('x') + "), ' ')")} AS body
FROM documents""")
def page_body_fallback(t: Tables):
    """Every other static page holds an empty body, so that its stored rendering is searched."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<p>"), F.array_join(F.split(safe, "\n"), "</p><p>"), F.lit("</p>"))
    static = F.concat(
        F.lit('<section data-testid="article-body">'),
        F.when(F.col("doc_id") % 2 == 0, body).otherwise(F.lit("<div>loading</div>")),
        F.lit("</section>"),
    )
    rendered = F.concat(F.lit("<article>"), body, F.lit("</article>"))
    stored = t.documents.select("doc_id", static.alias("html"), rendered.alias("rendered"))
    return page_ops.article_bodies(stored, "doc_id", "html", "rendered")
