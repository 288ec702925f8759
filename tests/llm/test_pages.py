import pytest
from pyspark.sql import functions as F

from gridloom.llm import html_extract, url_filter
from gridloom.llm.queries import URL_RULES

P = "Some words of the article that go on for a while, as they do. "


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b <br> c", "a\n\nb c"),
    ("<article><h1>T</h1><p><b>x<br><p>y&nbsp; z</p></article><footer>f</footer>", "T\n\nx\n\ny z"),
    ("<nav><a href=1>m</a></nav><script>var t='</p>';</script><style>p{}</style><!-- c --><p>x</p>", "x"),
    ("<div class='ad'>no</div><article><p>yes</p></article><section id=comments><p>" + P * 9 + "</p></section>", "yes"),
    ("<form><p>" + P + "</p></form><main><p>in</p></main><aside>s</aside>", "in"),
    ("<p hidden>h</p><p>" + P + "</p><unclosed", P.strip()),
    ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<script>only", ""), ("a < b and c > d", "a < b and c > d"),
])
def test_main_text(source, text):
    assert html_extract.main_text(source) == text


def test_core_of_generic_markup():
    body = "".join(f"<p>{P * 3}{i}</p>" for i in range(4))
    page = f"<body><div id=menu><a href=a>A</a></div><div><div class=post><h2>Head</h2>{body}</div><div class=sidebar><p>{P}</p></div></div><div class=cookie-notice>{P}</div></body>"
    text = html_extract.main_text(page)
    assert text.split("\n\n") == ["Head", *[f"{P * 3}{i}" for i in range(4)]]


def test_long_and_broken_pages():
    assert html_extract.main_text("<b>" * 20_000 + "x") == "x"
    assert len(html_extract.main_text("<p>" + "word " * 200_000)) == 999_999
    assert html_extract.main_text('<a title="' * 20_000).count("<") == 0


def test_extract_text(spark):
    rows = [(0, "u", "<p>x</p>"), (0, "u", "<p>x</p>"), (None, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    found = html_extract.extract_text(d)
    assert sorted(str(r.text) for r in found.collect()) == ["", "x", "x"] and sorted(found.columns) == ["page_id", "text", "url"]
    assert html_extract.extract_text(d.limit(0)).collect() == []


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest.partition("#")[0].partition("?")[0].partition("/")[0]
    path = rest.partition("#")[0].partition("?")[0][len(host) :]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.org?x=/", "http://example.org/es", "http://example.org/es/1#f", "http://www.Example.ORG/en/123?q",
            "http://example.org/en/2", "http://badexample.org/es/1", "http://x.com/fr/1", "http://com/de/", "http://É.com/de/x", "a://b://c.org/", "http://u@h.org:80/p", "http://x.com//fr/"]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, rule string")
    found = url_filter.judge_urls(d, URL_RULES)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {i: brute(u) for i, u in enumerate(urls + urls[:3])}
    assert url_filter.judge_urls(d.limit(0), URL_RULES).collect() == []


def test_trie_precedence():
    trie = url_filter.UrlTrie([("allow", "a.b/x"), ("block", "b"), ("block", "a.b/x/y"), ("allow", "c/"), ("block", "c/")])
    assert trie.match("z.a.b", "/xq") == ("a.b/x", "allow")
    assert trie.match("a.b", "/x/yy/z") == ("a.b/x/y", "block")
    assert trie.match("a.b", "") == ("b", "block") and trie.match("c", "/") == ("c/", "block") and trie.match("d", "/") is None


@pytest.mark.parametrize("page", [
    "<div class='content with-sidebar'>{}</div>", "<div id='page-header-wrap'><article>{}</article></div>", "<div class='layout no-menu'>{}</div>",
    "<form action=x><div class=sidebar>s</div><div>{}</div></form>", "<div class='menu wide'><main>{}</main></div>", "<div class=popup>{}</div>",
    "<article><header class='entry-header'>{}</header></article>", "<article><div class='article-header'>{}</div></article>",
])
def test_names_do_not_drop_the_article(page):
    body = "<h1>Head</h1>" + "".join(f"<p>{P * 3}{i}</p>" for i in range(4))
    assert html_extract.main_text(page.format(body)).split("\n\n") == ["Head", *[f"{P * 3}{i}" for i in range(4)]]


ARTICLE = "<h1>Head</h1>" + "".join(f"<p>{P * 3}{i}</p>" for i in range(4))
ARTICLE_TEXT = ["Head", *[f"{P * 3}{i}" for i in range(4)]]
LINKS = "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(8))


@pytest.mark.parametrize("around", [
    "page has-sidebar", "layout-with-sidebar", "single-post comments-open", "entry social-science", "header-wrap content", "related-work", "sidebar-layout",
    "no-menu", "comments-open", "ad-off", "banner-container", "show-nav", "content", "widget-wrapper", "post footer-on",
])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_layouts_keep_their_text(around, tag):
    """Hand-labelled: what stands around the text and beside it, in wrappers with such names."""
    page = f"<body><nav><ul>{LINKS}</ul></nav><{tag} class='{around}'>{ARTICLE}</{tag}><footer>Imprint, contact and terms</footer></body>"
    assert html_extract.main_text(page).split("\n\n") == ARTICLE_TEXT


@pytest.mark.parametrize("beside", [
    "<div class='user-discussion'><h3>2 comments</h3><p>Bob: {p}</p><p>Eve: {p}</p></div>", "<section id=comments><p>{p}</p></section>", "<div class='comment-list'><p>{p}</p></div>",
    "<ol class='post-comments'><li>{p}</li></ol>", "<div class='cookie-banner'><p>{p}</p></div>", "<div class='share-buttons'><a href=1>Post it</a></div>",
    "<aside><p>{p}</p></aside>", "<div class='left-sidebar'><p>{p}</p></div>", "<div class='related-posts'><ul>{links}</ul></div>", "<form><label>Mail</label><p>{p}</p></form>",
    "<div class='newsletter-box'><p>{p}</p></div>", "<div role=navigation><ul>{links}</ul></div>", "<div class=notice>{p}</div>", "<div class='top-ad'>{p}</div>",
])
@pytest.mark.parametrize("holder", ["<article>{}{}</article>", "<main>{}{}</main>", "<div class=post>{}{}</div>", "<div class=post>{}</div>{}"])
def test_what_is_beside_the_text_goes(beside, holder):
    assert html_extract.main_text("<body>" + holder.format(ARTICLE, beside.format(p=P, links=LINKS)) + "</body>").split("\n\n") == ARTICLE_TEXT


def test_parts_of_articles_stay():
    inside = "<section class='related-work'><p>" + P + "</p></section><div class='alert-systems'><p>" + P + "</p></div>"
    assert html_extract.main_text(f"<article>{ARTICLE}{inside}</article>").split("\n\n") == [*ARTICLE_TEXT, P.strip(), P.strip()]


def test_several_articles_stay_in_order():
    page = "<body><div class=list>" + "".join(f"<article><h2>Head {k}</h2><p>{P * 3}</p></article>" for k in range(3)) + f"</div><aside>{P}</aside></body>"
    assert html_extract.main_text(page).split("\n\n") == [x for k in range(3) for x in (f"Head {k}", (P * 3).strip())]


def test_comments_longer_than_the_text_go():
    page = f"<body><div class=post>{ARTICLE}</div><div id=comments>" + f"<p>{P * 4}</p>" * 6 + "</div></body>"
    assert html_extract.main_text(page).split("\n\n") == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["commentlist", "user-reviews", "google-ad-slot", "main-menu", "ad-box", "menu-ads"])
def test_names_inside_a_marked_article_go(name):
    assert html_extract.main_text(f"<body><article>{ARTICLE}<div class='{name}'><p>{P}</p></div></article></body>").split("\n\n") == ARTICLE_TEXT


def test_topics_stay_and_menus_go():
    page = "<body><article>{}<div class='menu-description'>{}</div></article></body>"
    assert html_extract.main_text(page.format(ARTICLE, f"<p>{P}</p>")).split("\n\n") == [*ARTICLE_TEXT, P.strip()]
    assert html_extract.main_text(page.format(ARTICLE, f"<ul>{LINKS}</ul>")).split("\n\n") == ARTICLE_TEXT
