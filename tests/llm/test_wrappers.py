import html
import random
import re

import pandas as pd

import __spark_entry__ as entry
from newswake.llm.wrappers import aligned, extracted, merged, parse, read_tree, write_tree

from .conftest import SF_DIR


def marked_article(page):
    """The article of a page of the given tables, cut out by its tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = [html.unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", b))) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for b in blocks if (x := " ".join(b.split())))


def text(page):
    return "\n\n".join(t for _, t in parse(page).article())


def test_query_against_the_marked_articles(spark):
    pages = pd.read_parquet(f"{SF_DIR}/pages.parquet")
    got = entry.queries()["op13_wrapper_induction"](spark, SF_DIR)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in got.collect()}
    assert len(got) == len(pages)
    for p in pages.itertuples():
        assert (got[p.page_id].url, got[p.page_id].text) == (p.url, marked_article(p.html))
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_blocks():
    assert text("<p>a <b>b</b>\n c&nbsp;&amp;d</p>tail") == "a b c &d\n\ntail"
    assert text("<p>one<p>two<br>three<div>four") == "one\n\ntwo three\n\nfour"
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a\n\nb\n\nc"
    assert text("<table><tr><td>1<td>2<tr><th>3</table>") == "1\n\n2\n\n3"
    assert text("<script>var t='</p>'; if (a<b) x</script><style>p{}</style><!-- <p>no</p> --><p>yes") == "yes"
    assert text("a<script>never closed <p>x") == "a"
    assert text("1 < 2 and &lt;p&gt; &#233; &eacute &nosuch; <p title='>'>q</p>") == "1 < 2 and <p> é é &nosuch;\n\nq"
    assert text("<p class=\"open>x</p><p>y</p>") == "x\n\ny"
    assert text("<p>x</p><p class='cut off") == "x"
    assert text("<head><title>t</title><p>body begins</p>") == "body begins"
    assert text("<p>a<button>press</button>b <span hidden>c</span>d</p>") == "ab d"
    assert text("<pre>a\n  b</pre><dl><dt>x<dd>y</dl>") == "a b\n\nx\n\ny"
    assert text("</p></div>x<div></div>") == "x" and text("") == "" and text("<>") == "<>"


def test_what_is_no_article():
    around = "<nav>menu</nav><header>head</header>{}<aside>side</aside><footer>foot</footer><form>f<p>g</p></form>"
    assert text(around.format("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article><p>outside</p>")) == "T\n\nx"
    assert text(around.format("<main><p>x</p></main><p>outside</p>")) == "x"
    assert text(around.format("<div class='post-body'><p>x</p></div>")) == "x"
    assert text("<body class='has-sidebar'><div id=sidebar><p>s</p></div><p>x</p><div class='cookieNotice'>c</div><div class='ad-slot'>a</div>") == "x"
    assert text("<article><p>x</p><section class='comments'><p>c</p></section></article><section id='comments'><article>c2</article></section>") == "x"
    assert text("<div class='site-header'>h</div><div class='post'><div class='post-header'>t</div><p>x</p></div>") == "t\n\nx"
    assert text("<ul><li><a href=/>one</a><li><a href=/2>two</a></ul><p>see <a href=/>there</a>, or here</p>") == "see there, or here"
    assert text("<div class='comments'><article><p>the only article</p></article></div>") == "the only article"
    assert text("<div role='banner'>b</div><p aria-hidden='true'>h</p><p style='display: none'>n</p><p>x</p>") == "x"


def test_alignment():
    shape = lambda page: parse(page).places()[0]
    assert shape("<div><p>a<p>b<ul><li>x<li>y</ul></div>") == "#page(div(p ul(li)))"
    one, two = shape("<div>m</div><div class=c><h1>t</h1><p>a</div>"), shape("<div>m</div><p>news</p><div class=c><p>a<p>b</div><div class=f>z</div>")
    template = merged([(3, one), (2, two)])
    assert template == "#page=5(div=5 p=2 div.c=5(h1=3 p=5) div.f=2)"
    assert write_tree(read_tree(template)) == template
    assert aligned(template, one) == (0, 1, 3, 4, 5) and aligned(template, two) == (0, 1, 2, 3, 5, 6)
    assert merged([(1, two), (99, one)]) == "#page=100(div=100 div.c=100(h1=99 p=100))"
    page = parse("<div>" * 500 + "deep" + "</div>" * 500)
    assert page.article() == [(500, "deep")] and page.places()[1][500] == page.places()[1][48]


def site(k, paragraphs, extra=""):
    """A page without any telling tag or name: only its host's other pages show what is template."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<html><body><div class=k1><span>The Daily Page</span></div><div class=k2>Welcome back, reader.</div>{extra}"
            f"<div class=k3><h2>Title {k}</h2>{body}<p>Write to our editors.</p></div><div class=k4><p>All rights kept.</p></div></body></html>")


def test_template_of_a_host(spark):
    rng = random.Random(4)
    words = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(12))
    rows, want = [], {}
    for k in range(40):
        paragraphs = [words() for _ in range(rng.randint(1, 9))] + (["A passage that many share."] if k % 3 == 0 else [])
        extra = f"<table><tr><td>{words()}</td></tr></table>" if k % 5 == 0 else ""
        rows.append((k, f"http://daily.example/{k}", site(k, paragraphs, extra)))
        cell = [re.search("<td>(.*?)<", extra)[1]] if extra else []
        want[k] = "\n\n".join([*cell, f"Title {k}", *paragraphs])
    copies = [(100 + k, f"http://daily.example/c{k}", rows[1][2]) for k in range(200)]  # of one page: nothing in it becomes template
    few = [(500 + k, f"http://few.example/{k}", site(k, ["x"])) for k in range(3)]  # too few pages: all text stays
    df = spark.createDataFrame(rows + copies + few, "page_id bigint, url string, html string")
    got = {r.id: r.text for r in extracted(df).collect()}
    assert {k: got[k] for k in want} == want
    assert {got[100 + k] for k in range(200)} == {want[1]}
    assert got[500] == "The Daily Page\n\nWelcome back, reader.\n\nTitle 0\n\nx\n\nWrite to our editors.\n\nAll rights kept."


def test_many_shapes_of_a_host(spark):
    """More shapes than one task merges: the template is the same in parts."""
    rows = [(k, "https://u@Wide.Example:8080/x", "<div>same</div>" + "".join(f"<div class={chr(97 + j)}>v{k}</div>" for j in range(8) if k >> j & 1))
            for k in range(1, 200)]
    got = {r.id: r.text for r in extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: "\n\n".join([f"v{k}"] * k.bit_count()) for k in range(1, 200)}


def test_edges(spark, tmp_path):
    long = "<p>" + "long word " * 300_000 + "</p>"
    rows = [(1, None, None), (1, None, ""), (1, "no address", "<p>x"), (None, "http://h/1", "<p>y"), (2, "http://h/2", long), (2, "http://h/2", long),
            (3, "http://h/3", "<div>" * 3000 + "z"), (4, "http://h/4", "<" * 5000), (5, "", "<nav>only</nav>")]
    schema = "page_id bigint, url string, html string, text string, host string, template string"
    spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, entry.queries()["op13_wrapper_induction"](spark, str(tmp_path)).collect()), key=str)
    texts = [(i, u, t) for (i, u, _), t in zip(rows, ["", "", "x", "y", *[("long word " * 300_000).strip()] * 2, "z", "<" * 5000, ""], strict=True)]
    assert got == sorted([(*t, len(t[2])) for t in texts], key=str)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert entry.queries()["op13_wrapper_induction"](spark, f"{tmp_path}/none").count() == 0
