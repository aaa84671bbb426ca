"""Wrapper inference and main text: planted articles on several layouts, odd markup, merge properties."""

from __future__ import annotations

import random
import re
from html import escape, unescape

import pytest
from pyspark.sql import functions as F

from sigtide.llm import wrappers
from sigtide.llm.htmltokens import TEXT, Page
from tests.conftest import SMALL


def text_of(html):
    """Main text of one page on a host of its own."""
    page = Page(html, wrappers._mute)
    own = wrappers.Wrapper(page.tokens, page.paths, 1)
    kept = {id(t) for t, k in zip(own.slots, wrappers.main_slots(own), strict=True) if k}
    return [x for t, x in page.blocks if id(t.found()) in kept]


def blocks_of(html):
    return [x for _, x in Page(html, wrappers._mute).blocks]


@pytest.mark.parametrize(("html", "want"), [
    ("", []), ("<", ["<"]), ("plain", ["plain"]), ("a < b and c > d", ["a < b and c > d"]),
    ("<p>one<p>two &amp; three&nbsp;x</p> tail", ["one", "two & three x", "tail"]),
    ("<p>a<br>b <b>c</b>d</p>", ["a b cd"]), ("<p><b>open<p>next", ["open", "next"]),
    ("<script>var t='</p><p>no</p>';</script><p>yes", ["yes"]), ("<style>p{}</style>x", ["x"]),
    ("<!-- <p>no</p> --><p>yes<!-- no", ["yes"]), ("<!doctype html><?x y?><p>t", ["t"]),
    ("<title>no</title><p>yes", ["yes"]), ("<head><title>t</title><p>body text", ["body text"]),
    ('<p title="a > b">x</p>', ["x"]), ('<p title="never ends>x</p><p>y</p>', ["x", "y"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<dl><dt>k<dd>v<dt>l</dl>", ["k", "v", "l"]), ("<p>cut <a href='x", ["cut"]), ("</p></div>x", ["x"]),
    ("<script>never ends <p>x</p>", []), ("<textarea><p>raw</p></textarea>y", ["y"]),
    ("<p>&lt;b&gt; &#8364; &#x41; &unknown; &amp</p>", ["<b> € A &unknown; &"]),
    ("<P CLASS=x>Up</P>", ["Up"]), ("</ 1>x", ["x"]), ("a\x00b", ["a\x00b"]), ("<div>" * 3000 + "deep", ["deep"]),
    ("<p>x<span class=ad>buy</span> y</p>", ["x y"]), ("<pre>a\n  b</pre>", ["a b"]),
])
def test_blocks(html, want):
    assert blocks_of(html) == want


ARTICLE = "<h1>Title</h1><p>One <a href=x>link</a> text.</p><p>Two.</p>"
WANT = ["Title", "One link text.", "Two."]


@pytest.mark.parametrize("html", [
    f"<body><header>Site</header><nav>Menu</nav><article>{ARTICLE}</article><footer>Foot</footer>",
    f"<body class='nav-open'><form id=all><div class=menu>Menu</div><main>{ARTICLE}</main></form>",
    f"<article><header>{ARTICLE[:14]}<p>By me</p></header>{ARTICLE[14:]}<aside>Side</aside></article>",
    f"<article>{ARTICLE}<div class=share>Share it</div><section id=comments><article>I say</article></section></article>",
    f"<main><div class='cookie-notice'>We use them</div>{ARTICLE}<form><p>Mail <button>Go</button></form></main>",
    f"<div role=banner>Top</div><div role=main>{ARTICLE}</div><div role=contentinfo>c</div>",
    f"<article>{ARTICLE}<div class='commentList'><p>me too</div></article><div id=sidebarRight><p>{'long ' * 99}</div>",
    f"<article>{ARTICLE}<p hidden>no</p><div style='display: none'>no</div><noscript>no</noscript></article>",
    f"<div class=header>Top</div>{ARTICLE}<div class=sidebar><ul><li><a href=x>No</a></ul></div>",
    f"<article>{ARTICLE}</article><section class=related><article>Other</article></section>",
])
def test_marked_layouts(html):
    assert text_of(html) == WANT


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta & < é 5".split()) + str(rng.randint(0, 99)) for _ in range(n))


def unmarked(rng, k):
    """A layout without names: only alignment tells the changing text from the template's."""
    paragraphs = [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 7))]
    notice = "<div><div>Site news of the day, the same on every page of this site, quite long indeed.</div></div>"
    body = "".join(f"<p>{escape(p)}</p>" for p in paragraphs)
    return (f"<body><div><a href=/>Home</a> <a href=/a>About this site</a></div>{notice if k % 3 else ''}"
            f"<div>{body}</div><div>Copyright of the site, all rights reserved by its owners, since ever.</div>", paragraphs)


def marked(rng, k):
    title, paragraphs = prose(rng, 5), [prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(0, 6))]
    ad = f"<div class='ad-{k}'>{prose(rng, 9)}</div>"
    body = "".join(f"<p>{escape(p)}" + (ad if k % 4 == 1 and i == 1 else "") for i, p in enumerate(paragraphs))
    items = "".join(f"<li><a href=x>{escape(prose(rng, 2))}</a>" for _ in range(rng.randint(1, 9)))
    return (f"<nav><ul>{items}</ul></nav>{ad if k % 2 else ''}<article id=post-{k}><h1>{escape(title)}</h1>{body}"
            f"</article><div class=comments><p>{escape(prose(rng, 200))}</div>", [title, *paragraphs])


def test_planted_pages(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        html, want = unmarked(rng, k)
        rows.append((k, "http://plain.example/x", html, "\n\n".join(" ".join(w.split()) for w in want)))
    for k in range(60, 160):
        html, want = marked(rng, k)
        rows.append((k, "https://marked.example/y?z", html, "\n\n".join(" ".join(w.split()) for w in want)))
    rows += [(200, None, "<article>no host</article>", "no host"), (201, "http://one.example", None, ""),
             (202, "http://one.example", "", ""), (203, "http://one.example", "<nav>only</nav>", ""),
             (None, "http://one.example", "<main><p>x</main>", "x"), (204, "http://big.example",
              "<article>" + "<p>long text here</p>" * 80_000 + "</article>", "\n\n".join(["long text here"] * 80_000))]
    rows += rows[60:62]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string").withColumn(
        "host", F.lit("h")).withColumn("blocks", F.lit(1)).repartition(6)
    for group in (wrappers.GROUP, 2):
        got = wrappers.main_text(df, group=group).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["text"] == r["want"] and r["n_chars"] == len(r["want"]) and r["host"] == "h", r["page_id"]
    assert wrappers.main_text(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="prefix"):
        wrappers.main_text(df.withColumn("text", F.lit("")))


def test_given_pages(spark):
    """The article of the given layout, cut out by patterns that know it."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))) for p in re.split(r"</?(?:h1|p)>", body)]
        want[r["page_id"]] = "\n\n".join(" ".join(p.split()) for p in parts if p.split())
    assert {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()} == want


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "p", "ul", "section", "div class=a", "div class=b"])
        inner = random_page(rng, depth + 1) if depth < 3 and tag != "p" and rng.random() < 0.6 else rng.choice(
            ["same", f"text {rng.randint(0, 9)}"])
        out.append(f"<{tag}>{inner}</{tag.split()[0]}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(30))
def test_alignment_keeps_every_token(seed):
    """Each token of each page has a place of its own name in the wrapper; counts add up."""
    rng = random.Random(seed)
    given = []
    for _ in range(8):
        page = Page(random_page(rng), wrappers._mute)
        given.append((wrappers.Wrapper(page.tokens, page.paths, 1), list(page.tokens), page.blocks))
    whole = given[0][0]
    for w, _, _ in given[1:]:
        whole = wrappers.merge(whole, w)
    place = {id(t): k for k, t in enumerate(whole.tokens)}
    assert whole.pages == 8 and len(place) == len(whole.tokens)
    for _, tokens, blocks in given:
        assert all(t.found().name == t.name and id(t.found()) in place for t in tokens)
        assert all(id(t.found()) in place for t, _ in blocks)
    texts = [x for _, _, blocks in given for _, x in blocks]
    assert sum(t.n for t in whole.slots) == len(texts)
    assert sum(t.chars for t in whole.slots) == sum(map(len, texts))
    by_slot = {}
    for _, _, blocks in given:
        for t, x in blocks:
            by_slot.setdefault(id(t.found()), set()).add(x)
    assert all((t.const is not None) <= (len(by_slot[id(t)]) == 1) for t in whole.slots)
    again = wrappers.Wrapper.load(whole.dump())
    assert again.dump() == whole.dump() and again.paths == whole.paths


def test_repeated_and_optional_groups():
    def tokens(html):
        page = Page(html, wrappers._mute)
        return wrappers.Wrapper(page.tokens, page.paths, 1)

    def show(w):
        return " ".join(("?" if t.opt else "") + ("+" if t.rep else "") + ("/" if t.kind == 2 else "") + (
            "#" if t.kind == TEXT else w.paths[t.path][1]) for t in w.tokens)

    assert show(tokens("<ul><li>a<li>b<li>c</ul>")) == "ul +li +# +/li /ul"
    assert show(tokens("<h2>a</h2><p>b<p>c</p><h2>d</h2><p>e</p>")) == "+h2 +# +/h2 +p +# +/p"
    one, two = tokens("<div>a</div><div>b</div>"), tokens("<div>a</div><div>b</div><div>c</div><p>x")
    assert show(wrappers.merge(one, two)) == "div # /div +div +# +/div ?p ?# ?/p"
    one, two = tokens("<div>a</div><p>z"), tokens("<div>a</div><h3>n</h3><p>z")
    assert show(wrappers.merge(one, two)) == "div # /div ?h3 ?# ?/h3 p # /p"
