"""URL filter and main text against plain Python."""

import random
import re
import time

import pytest

from tidemark.llm import html_main, url_filter
from tidemark.llm.page_queries import URL_RULES

SF = "/root/testdata/sf0.01"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(url):
    host, path = parts(url)
    best = None
    for action, rule in URL_RULES:
        domain, slash, tail = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + tail) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return best


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://xcom/", "https://a.example.com/en/x?u=://b.net/es/", "http://WWW.Example.COM/en/",
    "http://example.com/en", "http://example.com/En/", "http://a.net/es/#q", "http://a.net?x/es/", "http://a.net#/es/", "ftp://É.net/fr/é", "x://y://z.com/", "http://a\nb.com/\nq",
    "http://u:p@net:80/fr/", "http://www.example.com/" + "en/" * 5000, "http://a.net/fr/", "http://a.net/fr/",
]


def test_rules_and_parts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://b.com/")]
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, p_block int")
    out = {(r.page_id, r.host, r.path): r for r in url_filter.judged(frame, URL_RULES).collect()}
    assert len(out) == len(rows)
    for i, url in rows:
        r, best = out[(i, *parts(url))], rule_of(url)
        assert r.rule == (best and best[1])
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[0])
    assert url_filter.judged(frame.limit(0), URL_RULES).collect() == []


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    url = {r.page_id: r.url for r in pages.collect()}
    out = url_filter.judged(pages, URL_RULES).collect()
    assert len(out) == len(url)
    for r in out:
        best = rule_of(url[r.page_id])
        assert (r.host, r.path) == parts(url[r.page_id]) and r.rule == (best and best[1])
        assert best is None or r.verdict == best[0]


def test_trees_on_held_out_urls(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        host = f"{word(6)}-{draw.randrange(10**6)}.shop" if bad else f"{word(7)}.{draw.choice(['org', 'shop'])}"
        path = f"/{word(4)}/{draw.randrange(10**8)}" if bad else f"/{word(5)}/{word(6)}"
        rows.append((f"https://{host}{path}" + ("?a=1&b=2&c=3" if bad else ""), host, path, int(bad)))
    labelled = spark.createDataFrame(rows, "url string, host string, path string, label int")
    judge = url_filter.train(labelled.limit(800))
    held = judge.scored(spark.createDataFrame(rows[800:], labelled.schema), "url", "host", "path", "p").collect()
    assert sum((r.p >= 0.5) == bool(r.label) for r in held) >= 0.95 * len(held)


def test_suffix_shares_count_all_urls(spark):
    """Hosts beyond the sample of the trees have their own share, not the overall one."""
    rows = [(f"https://{'bad' if i % 2 else 'fine'}{i % 40}.org/p/{i}", f"{'bad' if i % 2 else 'fine'}{i % 40}.org", f"/p/{i}", i % 2) for i in range(800)]
    judge = url_filter.train(spark.createDataFrame(rows, "url string, host string, path string, label int"), sample=20)
    shares = {r.key: r.share for r in judge.shares.where("part = 'whole_host'").collect()}
    assert len(shares) == 40 and judge.overall == 0.5
    assert all(p == pytest.approx(((20 if h.startswith("bad") else 0) + 5 * 0.5) / 25) for h, p in shares.items())


def test_lexical_features_matter_on_held_out_hosts(spark):
    """Many parameters and digits are blocked by rules for single hosts; the trees must see it in hosts that no rule names."""
    def page(i, domain):
        bad = i % 2
        tail = f"item{i * 7919}?a={i}&b={i}&c={i}" if bad else "about-us"
        return f"http://h{i % 50 * 2 + bad}.{domain}/{tail}", bad

    pages = [page(i, "known.org") for i in range(400)]
    held = [page(i, "other.io") for i in range(400)]
    rules = [("block" if n % 2 else "allow", f"h{n}.known.org/") for n in range(100)]
    rows = [(i, u) for i, (u, _) in enumerate(pages + held)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judged(frame, rules).collect()}
    right = [(out[400 + i].verdict == "block") == bool(bad) for i, (_, bad) in enumerate(held)]
    assert all(out[400 + i].rule is None for i in range(400)) and sum(right) >= 0.95 * len(right)


def test_what_a_rule_names_has_no_share(spark):
    rows = [(f"http://a{i % 20}.net/{'es' if i % 2 else 'xx'}/{i}", f"a{i % 20}.net", f"/{'es' if i % 2 else 'xx'}/{i}", i % 2) for i in range(200)]
    labelled = spark.createDataFrame(rows, "url string, host string, path string, label int")
    judge = url_filter.train(labelled, rules=[("block", "net/es/"), ("allow", "a0.net/")])
    keys = {(r.part, r.key) for r in judge.shares.collect()}
    hosts = {f"a{i}.net" for i in range(1, 20)}
    assert keys == {("whole_host", h) for h in hosts} | {("last_two", h) for h in hosts} | {("first_segment", "xx")}


def test_one_kind_of_label(spark):
    frame = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judged(frame, URL_RULES).collect()] == ["allow"]
    only = url_filter.train(spark.createDataFrame([("u", "h", "/", 1)], "url string, host string, path string, label int"))
    assert [r.verdict for r in url_filter.judged(frame, [], judge=only).collect()] == ["block"]


def test_entropy_and_counts(value, spark):
    shape = url_filter.lexical(*(url_filter.F.lit(x) for x in ("http://a-b.com/x//y?q=1&r=2#f", "a-b.com", "/x//y")))
    row = spark.range(1).select(*(v.alias(k) for k, v in shape.items())).first()
    assert (row.depth, row.labels, row.parameters, row.hyphens, row.has_fragment, row.is_https) == (2, 2, 2, 1, 1, 0)
    assert value(url_filter._entropy(url_filter.F.lit("aabb"))) == 1.0 and value(url_filter._entropy(url_filter.F.lit(""))) == 0.0


# -- main text -----------------------------------------------------------------------------------

LONG = "A paragraph of some length, with commas, that says what the page is about, and then goes on for a while. "


@pytest.mark.parametrize(("source", "expected"), [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text &amp; more", "just text & more"),
    (f"<body><nav><a href=x>{LONG}</a></nav><div id=c><p>{LONG}<p>{LONG}</div><footer>{LONG}</footer>", LONG.strip() + "\n" + LONG.strip()),
    (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", "Title\n" + LONG.strip()),
    (f"<body><div class='side-bar sidebar'><p>{LONG*3}</p></div><h1>T</h1><div><p>{LONG}</p></div>", "T\n" + LONG.strip()),
    (f"<article><p>One<br>two\n\t three&nbsp;four</p><form><p>{LONG}</p></form><section class='comments'><p>{LONG}</p></section></article>", "One two three four"),
    (f"<article><p>{LONG}<script>var a='</p>'</script><style>p{{}}</style></p><!-- <p>no</p> --><p>b</article>", LONG.strip() + "\nb"),
    (f"<div class=ad><p>ad {LONG}<article><p>{LONG}</p></article>", LONG.strip()),
    ("<article><p>x < y &lt; z &#x41; &eacute; &bogus; &am</p><p title='a > b'>c</p></article>", "x < y < z A é &bogus; &am\nc"),
    (f"<article><ul><li>{LONG}<li>two</ul><table><tr><td>a<td>b</table></article>", LONG.strip() + "\ntwo\na\nb"),
    (f"<article><p>{LONG}</p><div class='cookie-notice'>We use cookies, many, many</div><div hidden>no</div><p>end</p></article>", LONG.strip() + "\nend"),
])
def test_main_text(source, expected):
    assert html_main.main_text(source) == expected


TEXT = LONG.strip()
REMARK = "I do not agree, at all, with what is said here, and would rather, if I may, add much more, as follows. " * 3


@pytest.mark.parametrize(("source", "expected"), [
    # readers' comments, in the layouts of blogs
    (f"<article><p>{LONG}</p></article><div id='comments'><ol class='comment-list'><li><article class='comment-body'><p>{REMARK}</p></article></ol></div>", TEXT),
    (f"<div class='post'><p>{LONG}</p></div><div id='comments'><article class='comment-body'><p>{REMARK}</p></article></div>", TEXT),
    (f"<article class='post comments-open'><p>{LONG}</p><article class='comment'><p>{REMARK}</p></article><p>end</p></article>", TEXT + "\nend"),
    (f"<main><article><p>{LONG}</p></article><article id='comment-7' class='comment'><p>{REMARK}</p></article></main>", TEXT),
    # several articles, and one around others
    (f"<div><article><p>{LONG}</p></article><article><p>{LONG}b</p></article><article><a href=x>more</a></article></div>", TEXT + "\n" + TEXT + " b"),
    (f"<article><h2>T</h2><article><p>{LONG}</p></article><p>end</p></article>", "T\n" + TEXT + "\nend"),
    # what is closed by itself or never
    (f"<article><svg viewBox='0'/><p>{LONG}</p><svg><path d='x'/><text>no</text></svg><p>b</p></article>", TEXT + "\nb"),
    (f"<article><button>Click <p>{LONG}</p><select><option>x<p>b</p><svg><p>c</p></article>", TEXT + "\nb\nc"),
    # inline elements that are not shown
    (f"<article><p>a <span style='display: none'>no <span>no</span> no</span>b <span class='advert'>no</span><ins class='adsbygoogle'>no</ins>c</p><p><i hidden>no</p><p>{LONG}</p></article>", "a b c\n" + TEXT),
    # an element named for its content is taken whole
    (f"<div class='content'><section><p>{LONG * 4}</p></section><section><h2>H</h2><p>short</p></section><ul><li>one<li>two</ul></div><div><p>x</p></div>",
     (LONG * 4).strip() + "\nH\nshort\none\ntwo"),
    (f"<div><div><p>{LONG * 4}</p></div><ul><li>one of the list, not short</li></ul><ul><li><a href=x>menu of links and links</a></ul></div>", (LONG * 4).strip() + "\none of the list, not short"),
])
def test_what_is_text_and_what_is_not(source, expected):
    assert html_main.main_text(f"<html><body>{source}</body></html>") == expected


@pytest.mark.parametrize("tag", ["div", "blockquote", "section", "li", "ul><li", "span", "table><tr><td"])
def test_deep_nesting_is_linear(tag):
    """Elements that are never closed, text at every level, and end tags that fit nothing."""
    started = time.time()
    source = f"<{tag}>word, " * 20_000 + "</main></h3></dl>" * 5000
    assert html_main.main_text(source).count("word") >= 1
    assert time.time() - started < 10


@pytest.mark.parametrize("name", [
    "content has-sidebar", "content no-sidebar", "container nav-open", "entry social-science", "story navy", "related-work", "wrapper sidebar",
])
def test_names_do_not_hide_the_whole_text(name):
    assert html_main.main_text(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div></body>") == LONG.strip() + "\n" + LONG.strip()


def test_unclosed_paragraphs_stay_linear():
    source = "<article>" + "<p>word" * 20000 + "<b>" * 5000 + "<div>" * 20000 + "x"
    assert html_main.main_text(source).count("word") == 20000


def test_articles_of_all_pages(spark):
    """The tables' pages name their article; its blocks are what must be found."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    out = html_main.extract(pages).collect()
    assert len(out) == len(source)
    for r in out:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", source[r.page_id], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r.n_chars == len(r.text)


def test_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    out = sorted(map(tuple, html_main.extract(frame).collect()), key=str)
    assert out == [(1, None, "", 0), (2, "u", "a", 1), (2, "u", "a", 1), (None, "u", "", 0)]
    assert html_main.extract(frame.limit(0)).collect() == []
