import html
import re

from quire.llm import html_extract as H
from quire.llm.queries import op8_html_extract

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body><header>site</header>
<div id="cookie-notice">cookies</div><nav><ul><li>a<li>b</ul></nav><div class="wrap"><div class="content"><h2>{t}</h2>
<p>One &lt;b&gt; &eacute;  a < b {t} and some more words for a body<p>Two{x}<ul><li>x<li>y</ul><form><input>Name</form>
</div><aside>side</aside></div><section class="comments"><p>reader</p></section><footer>f</footer>
<script>var a = "</p>";</script>"""


def article(source):
    """The blocks of the only article of a generated page."""
    inner = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", source, re.S)[1], flags=re.S)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split())
              for b in re.split(r"</?(?:h1|p|br|ul|li|div)[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def test_query_matches_the_articles(spark):
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op8_html_extract(spark, SF).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_wrapper_without_an_article_element():
    pages = [PAGE.format(t=f"Title {i}", x=f"<p>only here {i}" if i % 2 else "") for i in range(5)]
    wrapper = H.infer(pages)
    for i, page in enumerate(pages):
        t = f"Title {i}"
        want = [t, f"One <b> é a < b {t} and some more words for a body", "Two"]
        want += [f"only here {i}"] if i % 2 else []
        assert H.extract_text(page, wrapper).split("\n") == [*want, "x", "y"]


def test_alignment_forms():
    part = lambda *keys: [H.term(H.Node(k)) for k in keys]
    assert [(p["key"], p["repeated"]) for p in H.folded(part("h1", "p", "p", "p", "div"))] == [
        ("h1", False), ("p", True), ("div", False)]
    [group] = H.folded(part("dt", "dd", "dt", "dd", "dt", "dd"))
    assert group["key"] == "(dt dd)" and group["repeated"]
    both = H.aligned(part("h1", "p"), part("h1", "ul", "p"))
    assert [(p["key"], p["optional"]) for p in both] == [("h1", False), ("ul", True), ("p", False)]
    a, b = H.term(H.parse("<p>same</p><div>one</div>")), H.term(H.parse("<p>same</p><div>two</div>"))
    assert [p["slot"] for p in H.merged(a, b)["parts"]] == [False, True]


def test_awkward_rows(spark, monkeypatch):
    long = "<article>" + "<p>word &amp; more" * 20000 + "</article>"
    pages = spark.createDataFrame(
        [(1, "http://a.org/1", None), (2, "http://a.org/2", ""), (3, None, "<article>x<br>y</article>"), (4, "none", long),
         (5, "http://b.org/5", "<article><p>un<b>clo</i>sed <!-- c --> <a href='>'>link</a>"), (5, "http://b.org/5",
          "<article><p>un<b>clo</i>sed <!-- c --> <a href='>'>link</a>"), (None, "http://c.org", "<p>a <script>alert(1)"),
         (6, "http://d.org", "<div style='display: none'>no</div><main>yes</main><main class='ad-box'>no</main> < <")],
        "page_id long, url string, html string").selectExpr("*", "'h' as host", "'w' as wrapper", "'t' as text")
    want = {1: "", 2: "", 3: "x\ny", 4: "\n".join(["word & more"] * 20000), 5: "unclosed link", None: "a", 6: "yes"}
    for limit in (H.BROADCAST_BYTES, 0):
        monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
        rows = H.extract(pages).collect()
        assert len(rows) == 8 and {r["page_id"]: r["text"] for r in rows} == want
    assert H.extract(pages.where("false")).count() == 0


def test_every_template_of_a_host_is_read(spark):
    body = "<nav>menu</nav><div class='side-box'>the same on all</div>{}<footer>f</footer>"
    kinds = [("<article><h1>T{0}</h1><p>article text number {0}</article>", 100),
             ("<div class=content><h1>T{0}</h1><p>content text number {0} of ten</div>", 10),
             ("<div class=story><h1>T{0}</h1><p>story text number {0} of two</div>", 2),
             ("<main></main><div class=odd><h1>T{0}</h1><p>odd text beside an empty main {0}</div>", 1),
             ("<div class=copy><h1>T</h1><p>many copies of one page</div>", 9)]
    rows = [(f"http://h.org/{k}/{i}", body.format(form.format(i))) for k, (form, n) in enumerate(kinds) for i in range(n)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert len(got) == len(rows)
    for i, (_, source) in enumerate(rows):
        title, text = re.search(r"<h1>(.*?)</h1><p>(.*?)</", source).groups()
        assert got[i] == f"{title}\n{text}"


def test_a_hidden_element_hides_only_itself():
    shown, hidden = "<article><div>text {}</div></article>", "<article><div hidden>no {}</div><div>text {}</div></article>"
    wrapper = H.infer([hidden.format(i, i) for i in range(3)])
    assert H.extract_text(shown.format(9), wrapper) == "text 9"


def test_a_name_alone_does_not_lose_the_article():
    for source in ["<article class='post has-sidebar'>text</article>", "<article class='no-comments'>text</article>",
                   "<article class='entry social'>text</article>", "<main id=promo>text</main><nav>menu</nav>",
                   "<div class='has-sidebar'><p>text</div>"]:
        assert H.extract_text(source, H.infer([source])) == "text"
    titled = "<article><div class='entry-header'><h1>Title</h1></div><p>text</p><div class='post-comments'>no</div></article>"
    assert H.extract_text(titled, H.infer([titled])) == "Title\ntext"
    other = "<main>yes</main><main class='ad-box'>no</main><article class='related'>no</article>"
    assert H.extract_text(other, H.infer([other])) == "yes"


def test_deep_nesting(spark):
    """Thousands of open elements lose no text, keep what is outside out, and fail nowhere."""
    deep = "<div>" * 5000 + "<p>one{0}</p><nav>menu<div>more</div></nav><div>two</div>"
    rows = [(i, "http://deep.org/x", deep.format(i)) for i in range(3)]
    rows += [(9, "http://deep.org/y", "<article>" + "<ul><li>" * 2000 + "end" + "</ul>" * 2000 + "<p>after</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert got == {0: "one0\ntwo", 1: "one1\ntwo", 2: "one2\ntwo", 9: "end\nafter"}
