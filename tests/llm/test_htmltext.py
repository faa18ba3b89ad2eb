from tidemark.llm import batches, htmltext

FOLDER = "/root/testdata/sf0.01"
LONG = "A sentence of the article that is long enough to matter here. " * 3

CASES = {
    f"<nav><a href='/x'>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; site</footer>": f"Title\n{LONG.strip()}\nShort.",
    # unclosed tags, scripts with markup, comments, attributes with '>'
    "<script>var t='</p>';</script><!-- <p>no</p> --><article><h1>T</h1><p><b>One<br><p>Two &amp; <i>th</i>ree &lt;x&gt; &nbsp; y</article>": "T\nOne\nTwo & three <x> y",
    '<body><div class="x" data-y="a>b"><p>Text one is here.</p><p hidden>gone</p></div></body>': "Text one is here.",
    # parts set apart by their names
    f'<div id="cookie-notice">We use cookies.</div><div class="content has-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>Other {LONG}</p></div>'
    f'<section id="comments"><article class="comment"><p>I think {LONG}</p></article></section>': LONG.strip(),
    f"<header>Site</header><main><header><h1>Head</h1></header><p>{LONG}</p><aside>see also</aside><p>{LONG}</p><form>Name <input></form></main>": f"Head\n{LONG.strip()}\n{LONG.strip()}",
    # no marks at all: link lists weigh nothing, a far and short stretch is not dense enough
    "<div><a href=a>one</a></div><div><a href=b>two</a></div><div><a>three</a></div>" + f"<div>{LONG}</div><div>{LONG}</div>"
    + "<div><a>x</a></div>" * 4 + "<div>Tiny end.</div>": f"{LONG.strip()}\n{LONG.strip()}",
    "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>": "a b\nc",
    "plain text only": "plain text only", "<p>a < b and c</p>": "a < b and c", "<p>open <b": "open <b", "": "", "<nav>menu</nav>": "",
    "<textarea>x</textarea><script>never closed <p>a</p>": "",
}


def test_cases():
    for html, want in CASES.items():
        assert htmltext.main_text(html) == want, html[:80]


def test_inserts_drop_nothing_of_the_article():
    first, second, last = "a" * 700, "b" * 700, "c" * 200
    inserts = ('<div class="ad">Buy</div>', '<aside>See also</aside>', '<div class="share">Share</div><div class="notice">Note</div>', "<nav>x</nav>" * 5)
    for outer in ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<body>{}</body>", "{}"):
        for insert in inserts:
            page = outer.format(f"<h1>Title</h1>{insert}<p>{first}</p><p>{second}</p>{insert}<p>{last}</p>{insert}<p>End.</p>")
            assert htmltext.main_text(page) == f"Title\n{first}\n{second}\n{last}\nEnd.", page
    # in an element of its own, short text beyond a part set apart is still none of the article
    page = f'<div class="content"><p>{first}</p><p>{second}</p></div><div class="footer">Site</div><div>Powered by x</div>'
    assert htmltext.main_text(page) == f"{first}\n{second}"


def test_names_made_of_titles_drop_nothing():
    page = (
        f'<article><h1>Impact</h1><h2 id="social-impact">Social impact</h2><p>{LONG}</p><section id="search-and-rescue"><p>Rescue.</p></section>'
        f'<section id="discussion"><h2 class="section-header">Discussion</h2><p>So.</p></section><section id="comments"><p>I {LONG}</p></section></article>'
    )
    assert htmltext.main_text(page) == f"Impact\nSocial impact\n{LONG.strip()}\nRescue.\nDiscussion\nSo."
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>").replace('<section id="comments">', '<div class="comments">')
    assert "Social impact" in htmltext.main_text(plain) and "Rescue." in htmltext.main_text(plain) and "I A" not in htmltext.main_text(plain)


def test_teasers_displace_and_join_nothing():
    body = "".join(f"<p>{n} {LONG}</p>" for n in range(4))
    want = "\n".join(f"{n} {LONG.strip()}" for n in range(4))
    card = '<article class="card"><h3>Other</h3><p>Read this other story too.</p></article>'
    bare = card.replace(' class="card"', "")
    for teaser in (card, bare):
        assert htmltext.main_text(f'<body>{teaser}<div class="post-body">{body}</div></body>') == want
        for outer in ("<body>{}</body>", "<main>{}</main>", "<div class='row'>{}</div>"):
            assert htmltext.main_text(outer.format(f"<article><h1>Head</h1>{body}</article>{teaser}{teaser}{teaser}")) == f"Head\n{want}"
    # a short article with the only first heading stays the article beside long text without a mark
    assert htmltext.main_text(f"<div><p>About {LONG}</p></div><article><h1>Head</h1><p>Short.</p></article>") == "Head\nShort."
    # all of a marked article, also what is in links and far apart
    gap = "<ul>" + "<li><a href=x>one</a></li>" * 5 + "</ul>"
    assert htmltext.main_text(f"<article><p>{LONG}</p>{gap}<section><p>End.</p></section></article>") == f"{LONG.strip()}\n" + "one\n" * 5 + "End."


def test_query_gives_the_articles(spark):
    """The made pages hold one article element each; its blocks are what is to be found."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = htmltext.op9_html_extraction(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = inner.replace("</h1>", "\0").replace("</p>", "\0").replace("<br>", " ").replace("<p>", "\0")
        for tag in ("<h1>", "<b>", "</b>"):
            blocks = blocks.replace(tag, "")
        want = [" ".join(htmltext.unescape(b).split()) for b in blocks.split("\0")]
        assert r.text == "\n".join(b for b in want if b)
        assert r.n_chars == len(r.text)


def test_edge_rows(spark):
    batches.session(spark)
    rows = [(1, None), (2, ""), (None, "<p>x"), (3, "<div>" * 20000 + "deep" + "</div>" * 20000), (3, "<p>y"), (3, "<p>y"), (4, "<p>" + "a<b " * 100000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, html string, text string")
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.n_chars) for r in out.collect()))
    assert got[:6] == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (3, 4)] and len(got) == 7
    assert htmltext.extract(df.where("page_id > 9")).count() == 0
