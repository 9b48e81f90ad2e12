"""Main text of pages and URL verdicts against plain references."""
import re

import pytest

from riskloom.llm import html_text, url_filter
from riskloom.llm.registry import URL_RULES, op3_url_filter, op4_html_text

SF = "/root/testdata/sf0.01"


def article(page):
    """The given pages mark their article: its paragraphs, straight from the markup."""
    import html
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>|<[^>]*$", " ", body))
    return "\n".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())


def test_given_pages(spark):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op4_html_text(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  words\n here", "plain words here"),
    ("<p>one<p>two", "one\ntwo"), ("<article><p>a &amp; b &lt;c&gt; &eacute;</p></article><footer>no</footer>", "a & b <c> é"),
    ("<article><h1>T</h1><p>x <b>bold</b> y<br>z</p><script>if (a<b) '</p>'</script></article>", "T\nx bold y z"),
    ("<body><nav>menu menu</nav><div class='content'><p>Long text, really. It has some sentences.</p></div>"
     "<div class=\"side sidebar\">other words</div><div id=comments><p>me too, me too</p></div></body>",
     "Long text, really. It has some sentences."),
    ("<main><p>The body.</p><form><p>sign up</p></form><div class='cookie-notice'>cookies</div></main>", "The body."),
    ("<article><p>cut in the mid <foo", "cut in the mid"), ("<!-- never <p>x</p>", ""),
    ("<article><p title='a > b'>kept</p></article>", "kept"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd")])
def test_markup(page, text):
    assert html_text.main_text(page) == text


def test_given_pages_without_their_marker(spark):
    """The same text when nothing marks the article: the ratios find its container."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").limit(400).collect()
    for mark in ("<div>", "<div class='post body'>", ""):
        for r in rows:
            page = r.html.replace("<article>", mark).replace("</article>", "</div>" if mark else "")
            assert html_text.main_text(page) == article(r.html), (mark, r.page_id)


def test_the_ratios_decide(spark, monkeypatch):
    para = "A sentence of the text, with words; and more. " * 5
    page = f"<div><p>{para}</p><p>{para}</p></div><div><section><p>short words</p><p>more</p></section></div>"
    assert html_text.main_text(page.replace("<div><p>", "<div class=a><p>")) == "\n".join([para.strip()] * 2)
    monkeypatch.setattr(html_text, "_ratio", lambda chars, *_: 1.0 / chars)
    assert html_text.main_text(page.replace("<div><p>", "<div class=a><p>")) == "short words\nmore"


@pytest.mark.parametrize("page,text", [
    # reader comments, inside the article and as articles beside it
    ("<article><p>The text.</p><section id=comments><p>A long comment, with many words, and more.</p></section></article>",
     "The text."),
    ("<article><p>The text.</p><ol class='comment-list'><li><p>Me too.</p></li></ol></article>", "The text."),
    ("<article><p>The text, some words.</p></article><article class=comment><p>A comment.</p></article>",
     "The text, some words."),
    ("<article><h2 id='comments-on-method'>Comments on method</h2><p>The text.</p></article>",
     "Comments on method\nThe text."),
    # an unmarked page keeps its heading and its list
    ("<body><h1>Title</h1><p>" + "One long paragraph, with words. " * 20 + "</p><ul><li>a<li>b</ul></body>",
     "Title\n" + ("One long paragraph, with words. " * 20).strip() + "\na\nb"),
    ("<body><div><h1>Title</h1><section><p>First part, with words.</p></section><section><p>Second part, with words.</p>"
     "<table><tr><td>7</table></section></div><div class=links><a href=x>elsewhere</a></div></body>",
     "Title\nFirst part, with words.\nSecond part, with words.\n7"),
    # an inline advert does not cut its block
    ("<article><p>x <span class='ad'>buy</span> more</p></article>", "x more"),
    ("<article><p>x <span class='ad'>buy <b>now</b></span>, <a href=y>link</a> more</p></article>", "x , link more"),
    ("<div class='post comments-open'><p>The text, some words.</p></div>", "The text, some words."),
    # references do not join across tags
    ("<article><p>&am<b>p;</b> &lt<b>;</b></p></article>", "&amp; <;")])
def test_structure(page, text):
    assert html_text.main_text(page) == text


def test_short_blocks_beside_long_paragraphs():
    para = "Some words, more words; and then a few others. " * 6
    want = ["A heading of some length", *[para.strip()] * 6, *(f"item {i} of a short list" for i in range(5)), "Col", "7", "A caption"]
    page = (f"<h1>{want[0]}</h1>" + f"<p>{para}</p>" * 6 + "<ul>" + "".join(f"<li>{t}</li>" for t in want[7:12]) + "</ul>"
            "<table><tr><th>Col</th><td>7</td></tr></table><figure><img src=x><figcaption>A caption</figcaption></figure>"
            "<nav><p>menu</p></nav><div class=ad>buy</div>")
    for tag in ("article", "main"):
        text = html_text.main_text(f"<body><p>{para}</p><{tag}>{page}</{tag}><p>{para}</p></body>")
        assert text.split("\n") == want


@pytest.mark.parametrize("page,text", [
    ("<div class='content has-sidebar'><article><p>Text.</p></article><div class=sidebar>side</div></div>", "Text."),
    ("<div id='content-sidebar-wrap'><main><p>Text.</p></main></div>", "Text."),
    ("<main><div id='content-sidebar-wrap'><article><p>T.</p></article></div><p>Other text, as long.</p></main>",
     "T.\nOther text, as long."),
    ("<div class='no-comments'><p>Text, no article marked.</p></div>", "Text, no article marked."),
    ("<div class='sidebar-layout'><p>Most of the text, really.</p></div><div class=sidebar><p>side</p></div>",
     "Most of the text, really."),
    ("<article><p>Long text of a patient, with words.</p><h2 id='social-history'>Social history</h2><p>None.</p>"
     "<section id='search-methods'><p>We searched.</p></section><h2 id='related-work'><a href=#r>Related work</a></h2>"
     "<p class='notice-period'>A month.</p></article>",
     "Long text of a patient, with words.\nSocial history\nNone.\nWe searched.\nRelated work\nA month."),
    ("<article><p>The text, with some words; a few more.</p><section id=comments><p>me too</p></section>"
     "<section class='related-posts'><a href=x>Other post</a></section><p class=ad>buy</p>"
     "<div class='social-share'>share</div></article>", "The text, with some words; a few more."),
    ("<article><p>The text, with some words.</p></article><div id=comments><article><p>me too</p></article></div>",
     "The text, with some words."),
    ("<main><p>The body.</p><span class=ad>buy</span></main>", "The body.")])
def test_hints(page, text):
    assert html_text.main_text(page) == text


def test_long_and_odd_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {i}, with words.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, None), (2, "u", "<" * 5000), (3, "u", "<a " + "x='" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1].count("\n") == 19_999 and got[None] == ""
    assert html_text.extract(df.limit(0)).count() == 0


def verdict(url):
    """(host, path, rule, verdict or None) in plain Python."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(r), r, v) for v, r in URL_RULES
                if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith("/" + r.split("/", 1)[1])), default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules(spark):
    urls = ["http://EXAMPLE.org/es/1", "https://a.b.example.org/en/12#x", "x://example.org/en/2?q", "http://notorg/x",
            "http://org/a", "http://sub.com/fr/1", "http://sub.com/de/", "http://com/de/x?y", "no scheme", "", None,
            "a://b://c.org/", "http://x.org", "http://x.org?q=/", "http://É.COM/FR/", "\n://h\nost.org/p\nq?z", "http://",
            "http://example.org/en/1", "http://example.orgs/es/", "http://wexample.org/es/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (3, urls[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS features", "3 AS score")
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in
                  url_filter.filter_urls(df, URL_RULES).collect()), key=str)
    want = sorted(((str(i), *verdict(u)) for i, u in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == w[4] if w[4] else g[4] in ("allow", "block") for g, w in zip(got, want, strict=True))
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_given_urls_and_plan(spark):
    df = op3_url_filter(spark, SF)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in df.collect():
        host, path, rule, says = verdict(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (says or ("allow" if r.score >= 0.5 else "block"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_method_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = pages.select("url").selectExpr("url", "CASE WHEN url LIKE '%/de/%' THEN 0 ELSE 1 END AS label")
    rows = url_filter.filter_urls(pages, [], labelled.filter("crc32(CAST(url AS BINARY)) % 2 = 0"))
    rest = rows.join(pages, "page_id").filter("crc32(CAST(url AS BINARY)) % 2 = 1").toPandas()
    assert ((rest["verdict"] == "allow") == ~rest["path"].str.startswith("/de/")).mean() > 0.97


def test_a_repeated_url_takes_one_place_of_the_sample(spark):
    from pyspark.sql import functions as F
    urls = [f"http://site{i % 7}.org/{'ok' if i % 2 else 'spam'}/{i}" for i in range(40)]
    df = spark.createDataFrame([(u, i % 2) for i, u in enumerate(urls)], "url string, label int")
    first = df.orderBy(F.xxhash64("url")).limit(1)
    hot = first.crossJoin(spark.range(500)).select("url", "label").unionByName(df)
    assert isinstance(url_filter.train(first.unionByName(first), 100), float)
    model, plain = url_filter.train(hot, 100), url_filter.train(df, 100)
    assert not isinstance(model, float) and abs(model.intercept - plain.intercept) < 1e-6


def test_grams(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(url_filter._grams(F.lit("abc"), "h").alias("g"), url_filter._grams(F.lit(""), "p").alias("e")).first()
    assert row.g == ["h3:^ab", "h3:abc", "h3:bc$", "h4:^abc", "h4:abc$", "h5:^abc$"] and row.e == []
