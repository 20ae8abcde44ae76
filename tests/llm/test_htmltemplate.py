import html as entities
import random
import re
import time

import pytest

from litsift.llm import htmltemplate
from litsift.llm.htmltemplate import Page


def text(source, region=None, template=()):
    return Page(source).text(region, set(template))


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain  text\n here", "plain text here"), ("a < b &lt; c &amp;&#233; x&nbsp;y", "a < b < c &é x y"),
    ("<p>one<p>two<br>three<div>four</div>", "one\ntwo\nthree\nfour"),
    ("<p>a<b>b</b>c <i>d</i></p> e", "abc d\ne"),
    ("<body><nav>x</nav><header>y</header><p>z</p><footer>w<p>v</footer><aside>u</aside></body>", "z"),
    ("<nav><p>menu<article><h1>T</h1><p>body", ""),
    ("<div class='x sidebar-left'>s</div><div id=cookie-notice>c</div><div role=navigation>n</div><div class=headline>h</div>", "h"),
    ("<article class='post has-sidebar'><p>t<form>f</form><section class=comments><p>c</section></article><p>out", "t"),
    ("<article><p>a</p></article><article class=comment>b</article>", "a"),
    ("<main><p>m</p></main><p>out</p>", "m"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style>k<!-- c <p> --><textarea>f</textarea><title>t</title>", "k"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><p>cut <b>off</b> here</article><footer>x</foot", "cut off here"),
    ("<article><p>cut at <a hre", "cut at"), ("<p title='a>b'>q</p><p title=\"c>d\">r</p>", "q\nr"),
    ("<P CLASS=Ad>no</P><DIV>yes</DIV></div></p></article>", "yes"), ("x<![CDATA[<b>]]>y", "x<b>y"),
])
def test_one_page(source, want):
    assert text(source) == want


def pages(host, n, extra=""):
    out = []
    for i in range(n):
        out.append((f"https://{host}/{i}", "<html><body><div class=top>Site name</div><div class=story><p>"
                    + " ".join(f"w{i}x{k}" for k in range(30)) + f"<p>second {i}</div>{extra}"
                    + "<div class=low><p>All rights kept</p></div></body></html>"))
    return out


def run(spark, rows):
    data = [(i, u, h, 1, "t") for i, (u, h) in enumerate(rows)]
    got = htmltemplate.extract(spark.createDataFrame(data, "page_id long, url string, html string, id long, text string"))
    return {r.page_id: r.text for r in got.collect()}


def test_template_of_a_host_goes_and_slots_stay(spark):
    rows = pages("a.example", 6) + pages("b.example", 2) + [(None, None), ("odd", "<p>x"), ("https://a.example/z", "")]
    got = run(spark, rows)
    for i in range(6):
        assert got[i] == " ".join(f"w{i}x{k}" for k in range(30)) + f"\nsecond {i}"
    # two pages are no evidence
    assert got[6].startswith("Site name\n") and got[6].endswith("All rights kept")
    assert got[8] == "" and got[9] == "x" and got[10] == ""


def test_repeated_passages_of_articles_stay(spark):
    rows = [(f"http://h.example/{i}", f"<nav>n</nav><article><h1>Same</h1><p>Licence text.</p><p>{i}</p></article>") for i in range(8)]
    assert run(spark, rows) == {i: f"Same\nLicence text.\n{i}" for i in range(8)}


def test_empty_table_and_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert htmltemplate.extract(table.limit(0)).count() == 0
    got = {r.page_id: (r.text, r.n_chars) for r in htmltemplate.op2_template_text(spark, "/root/testdata/sf0.001").collect()}
    for r in table.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(b.replace("<b>", "").replace("</b>", "")).split())
                  for b in re.split(r"</?(?:p|h1|br)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_template_decides_in_articles(spark):
    rows = [(f"http://h.example/{i}", f"<article id=slug-{'abcdef'[i]}><h1>T{i}</h1><div class=byline-box>By <div class=who>Site name</div></div>"
             f"<div class=entry><p>Licence text.</p><p>own {i}</p></div></article>") for i in range(6)]
    rows += [(f"http://few.example/{i}", h) for i, (_, h) in enumerate(rows[:2])]
    got = run(spark, rows)
    for i in range(6):
        assert got[i] == f"T{i}\nLicence text.\nown {i}"
    assert got[6] == "T0\nBy\nSite name\nLicence text.\nown 0"


def test_copies_are_no_evidence(spark):
    page = "<html><body><div class=top>Site name</div><div id=slug-of-this><p>The only text</p><p>of this page</p></div></body>"
    printed = "<body><nav>back</nav><div class=print><b>Site name</b></div><p>The only text<p>of this page</body>"
    rows = [(f"http://copies.example/a?{i}", page) for i in range(5)] + [("http://copies.example/print", printed)]
    rows += pages("a.example", 6) + [(f"http://a.example/slug?{i}", page) for i in range(4)]
    got = run(spark, rows)
    for i in range(6):
        assert got[i] == "Site name\nThe only text\nof this page"
    for i in range(12, 16):
        assert got[i] == "The only text\nof this page"


def test_words_of_ids_and_classes_drop_nothing_without_evidence(spark):
    kept = ("<section id=related-work>a</section><section id=header-files>b</section><h2 id=social-policy>c</h2><p id=notice-of-appeal>d</p>"
            "<div class=share-price>e</div><div id=reply>f</div>")
    assert text(f"<article>{kept}</article>") == text(f"<main>{kept}</main>") == "a\nb\nc\nd\ne\nf"
    assert text("<body><h2 id=social-policy>c</h2><div class=share>s</div><p>d") == "c\nd"
    rows = [(f"http://h.example/{i}", f"<article><p>own {i}</p><div class=related>More {i}</div><div id=comments>c{i}</div>"
             f"{'<div class=notice>Text of the notice</div>' if i == 2 else ''}</article>") for i in range(5)]
    got = run(spark, rows)
    assert got == {i: f"own {i}" for i in range(5)}  # a hint on one page of five holds


def test_rare_furniture_goes_at_any_size_of_host(spark):
    for n in (1, 2, 4, 9):
        rows = [(f"http://h.example/{i}", f"<article><p>own {i}</p>" + ("<div class=advert>Buy cheap shoes now</div>"
                 "<div class=comments>Great post, bob</div>" if i == 0 else "") + "</article>") for i in range(n)]
        assert run(spark, rows) == {i: f"own {i}" for i in range(n)}


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "ad-banner", "advert-box", "social-share", "comments_area"])
def test_compound_classes_of_furniture_go(name):
    assert text(f"<article><p>own</p><div class={name}>x</div></article>") == "own"


def test_comment_sections_go():
    for source in ("<section id=comments>x</section>", "<div id=comments><p>x</div>", "<div id=disqus_thread>x</div>",
                   "<section id='comments-section'><h2>Comments</h2>x</section>"):
        assert text(f"<article><p>own</p>{source}</article>") == text(f"<main><p>own</p>{source}</main>") == "own"


def test_a_teaser_does_not_stand_for_a_long_main():
    long = "The long text of the page goes on and on. " * 5
    assert text(f"<article><p>Teaser</article><main><p>{long}</main>") == long.strip()
    assert text(f"<main><p>{long}<article><p>Teaser</article><p>end</main>") == f"{long.strip()}\nTeaser\nend"
    assert text(f"<main><p>short</p><article><p>{long}</article></main>") == long.strip()


def test_the_template_clears_a_hint_that_frames_the_main_text(spark):
    rows = [(f"http://h.example/{i}", f"<body><div class='page widget'><p>{'own words of page ' * 9}{i}</p></div>"
             f"<div class=widget>little</div></body>") for i in range(5)]
    got = run(spark, rows)
    assert all(got[i].startswith("own words of page") for i in range(5))


@pytest.mark.parametrize("tag", ["<div>", "<p>", "<b>", "<div class=ad>", "<article>", "<li>", "<ul><li>", "<table><tr><td>"])
def test_deep_pages_take_linear_time(tag):
    began = time.perf_counter()
    page = Page("<body>start" + tag * 100_000 + "<p>deep</p>" + "x<br>y" * 10)
    page.text(None, set())
    page.counts()
    page.keys()
    assert time.perf_counter() - began < 20
    assert any(b.text.startswith("deep") or "deep" in b.text for b in page.blocks)


def plain_classes(hosts):
    """Template texts of a host by occurrence vectors written out: {host: {(path, text)}}."""
    out = {}
    for host, sources in hosts.items():
        pages, seen = [], set()
        for source in sources:
            page = Page(source)
            if page.signature() not in seen:
                seen.add(page.signature())
                pages.append(page)
        vectors = {}
        for i, page in enumerate(pages):
            for path, n in page.elements.items():
                vectors.setdefault(("element", path, ""), {})[i] = n
            for b in page.blocks:
                if b.place and not b.inner:
                    own = vectors.setdefault(("text", b.path, b.text), {})
                    own[i] = own.get(i, 0) + 1
        elements = [(path, v) for (kind, path, _), v in vectors.items() if kind == "element" and len(v) >= htmltemplate.MIN_PAGES]
        out[host] = {(path, t) for (kind, path, t), v in vectors.items() if kind == "text" and any(
            v == w and (path == above or path.startswith(above + "/")) for above, w in elements)}
    return out


def test_classes_against_vectors_written_out(spark):
    draw = random.Random(2)
    hosts = {}
    for h in range(4):
        parts = [f"<div class=c{k}><p>fixed {k}</p></div>" for k in range(4)]
        hosts[f"h{h}.example"] = ["<body>" + "".join(p for p in parts if draw.random() < 0.8) + "".join(
            f"<div class=slot><p>{draw.choice('abcdef')}{draw.randrange(40)}</p></div>" for _ in range(3)) + "</body>" for _ in range(12)]
    want = plain_classes(hosts)
    rows = [(f"http://{h}/{i}", source) for h, sources in hosts.items() for i, source in enumerate(sources)]
    df = spark.createDataFrame([(u.split("/")[2], u, s) for u, s in rows], "host string, digest string, html string")
    marks = {(r.host, r.key) for r in htmltemplate.deduce(htmltemplate._tokens(htmltemplate._parsed(df))).collect()}
    for host, sources in hosts.items():
        for source in sources:
            for b in Page(source).blocks:
                assert ((host, htmltemplate._key(b)) in marks) == ((b.path, b.text) in want[host])
    assert any(want.values())
