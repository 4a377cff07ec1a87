"""Extraction: hand-made pages, and the article of the generated ones."""

import html
import random
import re
import time

import pytest
from conftest import SF

from windrow.llm import pages
from windrow.llm.queries import QUERIES

CHROME = "<html><head><title>t</title><style>p{}</style></head><body><header><div>Site</div></header><nav><a>Home</a></nav>{}<aside>More</aside><footer>&copy; us</footer><script>var a='<p>no</p>'</script></body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>One<br>two\n three</p><p><b>Open<p>next</article>", "A & B\nOne two three\nOpen\nnext"),
        ("<article><p>x</p><div class='ad'>buy</div><p>y<span class=\"share-button\">tweet</span>z</p><form><p>mail</p></form></article>", "x\nyz"),
        ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "a\nb\n1\n2"),
        ("<article><p>real text of the page</p></article><div id=comments><article class=comment><p>reader</p></article></div>", "real text of the page"),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;c</p><!-- <p>no</p> --><p hidden>h</p><p style='display: none'>n</p></article>", "a <b> é c"),
        ("<article></article>", ""),
        ("<article><p>it's <a href=\"x>y\">link</a>ed</p><select><option>o</select><button>b</button></article>", "it's linked"),
    ],
)
def test_one_page(body, want):
    assert pages.main_text(pages.tree(CHROME.replace("{}", body))) == want


@pytest.mark.parametrize("text", ["", None, "plain", "<", "<p", "</p></div>", "<div>" * 3000, "<!-- never closed", "<script>never closed", "<p>a</b></p><td>x"])
def test_odd_pages_do_not_crash(text):
    assert isinstance(pages.main_text(pages.tree(text)), str)


def test_deep_pages():
    deep = "<article>" + "".join(f"<div>{k}" for k in range(2000)) + "</article>"
    assert pages.main_text(pages.tree(deep)).split("\n") == [str(k) for k in range(2000)]
    a, b = pages.tree(deep), pages.reference(pages.as_json(pages.tree(deep)))
    assert pages.aligned(a, b)[0] == a.size == len(pages.nodes(a))
    inner = "<div>" * 700 + "<nav>menu</nav><p>x</p>"
    assert pages.main_text(pages.tree("<body>" + inner + "</body>")) == "x"
    assert pages.aligned(pages.tree(inner), pages.tree("<div>" * 699 + "<p>y</p>"))[0] == 700  # the root and 699 blocks


def brute_matching(a, b):
    if a.label != b.label:
        return 0
    rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + brute_matching(x, y))
    return 1 + rows[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_matching_is_the_largest(seed):
    rng = random.Random(seed)

    def block(depth):
        t = rng.choice("p h2 ul li div section".split())
        return f"<{t}>x</{t}>" if depth == 0 or rng.random() < 0.3 else f"<div>{''.join(block(depth - 1) for _ in range(rng.randrange(6)))}</div>"

    a, b = (pages.tree("".join(block(3) for _ in range(rng.randrange(1, 9)))) for _ in range(2))
    size, pairs = pages.aligned(a, b)
    assert size == brute_matching(a, b) == len(pairs)
    kin = {id(k): x for t in (a, b) for x in pages.nodes(t) for k in x.kids}
    seen = {(id(x), id(y)) for x, y in pairs}
    assert all(x.label == y.label and (x is a or (id(kin[id(x)]), id(kin[id(y)])) in seen) for x, y in pairs)
    assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


@pytest.mark.parametrize("n", [600, 900, 3000])
def test_wide_pages_align_exactly_and_fast(n):
    kinds = ["<h2>h</h2><p>x</p>", "<p>x</p><ul><li>a</li><li>b</li></ul>", "<div><p>x</p><h3>y</h3></div>", "<p>x</p><p>y</p><pre>z</pre>"]
    rng = random.Random(n)
    some = [rng.choice(kinds) for _ in range(n)]
    a, b = pages.tree("".join(["<section><p>new</p></section>", *some, "<p>end</p>"])), pages.tree("".join([*some, "<section><h2>new</h2></section><p>end</p>"]))
    began = time.process_time()
    size, pairs = pages.aligned(a, b)
    assert time.process_time() - began < 1.5
    assert size == len(pairs) >= min(a.size, b.size) - 2


def test_matching_is_simple_tree_matching():
    def f(s):
        root = pages.tree(s)
        return root

    a, b = f("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>"), f("<div><p>1</p><div><p>ad</p></div><ul><li>x</li></ul><p>3</p></div>")
    size, pairs = pages.aligned(a, b)
    assert size == 6 == len(pairs)
    assert {(x.text, y.text) for x, y in pairs if x.text} == {("1", "1"), ("x", "x"), ("2", "3")}


def host_pages(n, host="h.example"):
    for k in range(n):
        yield k, f"https://{host}/{k}", f"<body><div class=top><p>Welcome to the site</p></div><div class=body><p>story {k} " + "word " * 20 + f"</p><p>Read our terms</p><p>end {k}</p></div><div class=bottom><p>Imprint</p></div></body>"


def test_template_of_a_host_is_left_out(spark):
    rows = [*host_pages(12), (100, "https://one.example/", "<body><div><p>Alone</p></div></body>"), (101, None, "<p>no host</p>"), (102, "https://h.example/x", None), (100, "https://one.example/", "<body><div><p>Alone</p></div></body>")]
    d = spark.createDataFrame([(*r, 1, 1) for r in rows], "page_id long, url string, html string, host int, trees int")
    got = sorted((r["id"], r["text"]) for r in pages.extract(d).collect())
    want = [(k, f"story {k} " + " ".join(["word"] * 20) + f"\nend {k}") for k in range(12)] + [(100, "Alone"), (100, "Alone"), (101, "no host"), (102, "")]
    assert got == want
    assert pages.extract(d.limit(0)).count() == 0


def story(k, paragraphs):
    return [f"part {j} of story {k} " + f"word{k}x{j} " * 12 for j in range(paragraphs)]


def shown(paragraphs, before="", after=""):
    return "<body><div class=top><p>Welcome to the site</p></div><article>" + before + "".join(f"<p>{x}</p>" for x in paragraphs) + after + "<p>Read our terms</p></article></body>"


def extracted(spark, htmls):
    rows = [(k, f"https://h.example/{k}", h) for k, h in enumerate(htmls)]
    got = {r["id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(len(rows))]


def test_page_without_an_article_keeps_all_that_varies():
    body = f"<p>long text {'word ' * 40}</p>"
    page = CHROME.replace("{}", f"<div class=post><h1>Title</h1><p>lead</p><div class=body>{body}</div><p>closing</p></div>")
    assert pages.main_text(pages.tree(page)).split("\n") == ["Title", "lead", "long text " + " ".join(["word"] * 40), "closing"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body class='has-sidebar'><article><p>text</p></article></body>", "text"),
        ("<html class='no-overlay'><body class='menu-open sticky-header' style='display:none'><p>text</p></body></html>", "text"),
        ("<body><article class='post no-comments'><p>text</p></article></body>", "text"),
        ("<body><main id='search-results'><p>text</p></main></body>", "text"),
        ("<body><div class='page has-sidebar'><p>most of the text</p></div><div class=sidebar>more</div><p>end</p></body>", "most of the text\nend"),
        ("<body><p>short</p><div id=comments><p>what a reader wrote at length</p></div></body>", "short"),
        ("<body><article><p>short</p></article><div class='user-comments'><p>what a reader wrote at length</p></div></body>", "short"),
        ("<body><div id=comments><p>only this</p></div><nav>Home</nav></body>", "only this"),
        ("<body class='no-sidebar'><p>text</p></body>", "text"),
        ("<body><div class='content with-sidebar'><p>text</p></div><p>other text of more words than that</p></body>", "text\nother text of more words than that"),
        ("<body class='widget-ready not-login'><form action=/><div><p>text</p><input name=q><select><option>o</select></div></form></body>", "text"),
        ("<body><form><header>Site</header><article><p>text</p></article><p>a long text beside the article in the form</p></form></body>", "text"),
        ("<body><div class=sidebar><article><p>the only one</p></article></div><p>a longer text than that, without an article</p></body>", "the only one"),
        ("<article><p title='a hidden gem'>a</p><p data-x='not hidden at all'>b</p><p hidden>c</p><p aria-hidden=true>d</p></article>", "a\nb"),
        ("<article><section id='related-work'>a</section><div id='search-algorithms'>b</div><p class=notice>c</p><p>d <span class=alert>e</span> <label>f</label></p></article>", "a\nb\nc\nd e f"),
        ("<body><article><p>one</p></article><p>between</p><article><p>two, and longer</p></article></body>", "one\ntwo, and longer"),
        ("<main><p>text</p><article class='comment'><p>reader</p></article></main>", "text"),
    ],
)
def test_names_of_large_blocks(page, want):
    assert pages.main_text(pages.tree(page)) == want


@pytest.mark.parametrize("edited", [False, True])
def test_copies_of_a_long_article_keep_their_text(spark, edited):
    copies = [[*story(0, 20)] for _ in range(7)]
    if edited:
        for k, c in enumerate(copies):
            c[3 + k] = f"edited {k} " + "other " * 10
    short = [story(k, 2) for k in range(1, 9)]
    got = extracted(spark, [shown(x) for x in [*copies, *short]])
    want = ["\n".join(" ".join(x.split()) for x in s) for s in [*copies, *short]]
    assert [g.removesuffix("\nRead our terms") for g in got] == want


@pytest.mark.parametrize(("notice", "left"), [("<div class=x{0}><p>Sign up for {0}</p></div>", 0), ("<p>Sign up for {0}</p>", 36)])
def test_template_that_neither_reference_has(spark, notice, left):
    """Six notices on six pages each: left out in a block of their own; one more paragraph of the article stays."""
    got = extracted(spark, [shown(story(k, 3), before=notice.format(k // 6) if k < 36 else "") for k in range(40)])
    assert sum("Sign up for" in g for g in got) == left
    assert all(f"part {j} of story {k} word{k}x{j}" in g for k, g in enumerate(got) for j in range(3))


def without_article(k, paragraphs):
    """A page whose boilerplate has no telling element or name: only its host's other pages show it."""
    foot = ("All rights are with the publisher", "Alle Rechte beim Verlag", "Tous droits au journal")[k % 3]
    bar = "".join(f"<div class=x7><p>{x}</p></div>" for x in ("World", "Money", "Sport"))
    return f"<body><div class=a1><p>The Daily Example</p>{bar}</div><div class=b2><h1>Story {k}</h1>{''.join(f'<p>{x}</p>' for x in paragraphs)}<div class=q3>You may also like our letter</div></div><div class=z9><p>{foot}</p></div></body>"


def test_the_wrapper_decides_where_no_element_tells(spark, monkeypatch):
    """Without the host's other pages every line of boilerplate stays; with them, none."""
    chrome = {"The Daily Example", "World", "Money", "Sport", "You may also like our letter", "All rights are with the publisher", "Alle Rechte beim Verlag", "Tous droits au journal"}
    htmls = [without_article(k, story(k, 1 + k % 7)) for k in range(30)]
    want = ["\n".join([f"Story {k}", *(" ".join(x.split()) for x in story(k, 1 + k % 7))]) for k in range(30)]
    assert extracted(spark, htmls) == want
    alone = [pages.main_text(pages.tree(h)).split("\n") for h in htmls]
    assert all(len(chrome & set(x)) == 6 for x in alone)
    monkeypatch.setattr(pages, "LEAST_PAGES", 1000)
    assert extracted(spark, htmls) == ["\n".join(x) for x in alone]


def test_generated_pages(spark, duck):
    got = {r["page_id"]: r for r in QUERIES["op4_pages"](spark, SF).collect()}
    rows = duck.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(rows) == len(got)
    for i, h in rows:
        a = re.sub(r"</?(h1|p)>", "\0", h[h.find("<article>") + 9 : h.find("</article>")].replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", a).split("\0")) if x)
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))
