import html
import json
import re
import time
from collections import Counter, defaultdict

from lodespark.llm import template as T
from lodespark.llm.catalogue import table

SCHEMA = "page_id bigint, url string, html string, host int"


def test_generated_pages(spark):
    """On the generator's own layout the wanted text can be read off with two patterns."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = T.main_text(pages).collect()
    src = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(src)
    for r in got:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", src[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?:b|/b)>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def site(i, body, host="a.example"):
    return (i, f"http://{host}/{i}", body, 1)


def texts(spark, rows):
    got = defaultdict(list)
    for r in T.main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.page_id].append(r.text)
    return got


def test_layouts_and_odd_rows(spark):
    def page(i, extra=""):
        return f"""<html><head><title>T{i}</title></head><body><div class="site-header">Site</div><div id="cookie-notice">We use cookies {i}</div><ul class="menu"><li>Home</li></ul>
<div class="content"><h1>Title &lt;{i}&gt;</h1><p>One <i>two</i>{i}&nbsp;three<br>four</p>{extra}<div>Tail {i}</div></div><div class="sidebar">Side {i}</div><section id="comments"><p>Nice {i}</p></section><form><input><label>Mail</label></form></body></html>"""

    rows = [site(i, page(i, '<aside>see also</aside><div class="ad">Buy</div>' if i % 2 else "")) for i in range(6)]
    rows += [site(10, None), site(11, ""), (12, None, "<p>no host", 1), site(13, "<article><header><h2>H</h2></header><p>x < y &amp; z</article><p>after", "solo.example"), site(13, "<script>var a='<p>'</script>t", "solo2.example")]
    got = texts(spark, rows)
    for i in range(6):
        assert got[i] == [f"Title <{i}>\nOne two{i} three four\nTail {i}"]
    assert got[10] == [""] and got[11] == [""] and got[12] == ["no host"]
    assert sorted(got[13]) == ["H\nx < y & z", "t"]
    empty = spark.createDataFrame([], SCHEMA)
    assert T.main_text(empty).collect() == []


def plain(i, own=None):
    """A page without an article element and without telling names."""
    links = "".join(f'<li><a href="/{i}/{k}">Link {i} {k}</a></li>' for k in range(3 + i % 3))
    return f"<html><body><div>Site name</div><div><a href=/>Home</a> <a href=/s>Shop</a></div><div><ul>{links}</ul></div><div><h1>Title {i}</h1><p>{own or f'Body {i} with a <a href=x>link</a> in it'}</p></div><div>All rights kept</div></body></html>"


def test_the_template_decides_without_names(spark):
    """Header, menus (the same and changing ones) and the last line go at two pages of a host as at nine; without a template they would stay."""
    rows = [site(100 * n + i, plain(i), f"h{n}.example") for n in (2, 3, 7, 8, 9) for i in range(n)]
    got = texts(spark, rows)
    for n in (2, 3, 7, 8, 9):
        for i in range(n):
            assert got[100 * n + i] == [f"Title {i}\nBody {i} with a link in it"]
    assert T.extract(plain(1), {}).startswith("Site name\n")


def test_copies_and_shared_paragraphs_keep_their_text(spark):
    """Copies of one page tell nothing of a frame; what all articles of a host share stays in them."""

    def page(i, tag):
        return f"<html><head><title>T</title></head><body><div>Frame line</div><{tag}><h1>Head</h1><p>Shared words</p><p>Own {i}</p></{tag}></body></html>"

    rows = [site(n * 100 + i, page(0, "article"), f"copies{n}.example") for n in (1, 7, 8) for i in range(n)]
    alone = [site(2000 + n * 100 + i, page(0, "div"), f"plain{n}.example") for n in (1, 7, 8) for i in range(n)]
    for element, base in (("article", 4000), ("main", 8000)):
        rows += [site(base + n * 100 + i, page(i, element), f"{element}{n}.example") for n in (2, 7, 9) for i in range(n)]
    rows += [site(6000 + i, page(i, "div"), "frame.example") for i in range(2)]
    got = texts(spark, rows) | texts(spark, alone)
    for n in (1, 7, 8):
        for i in range(n):
            assert got[n * 100 + i] == ["Head\nShared words\nOwn 0"]
            assert got[2000 + n * 100 + i] == ["Frame line\nHead\nShared words\nOwn 0"]
    for base in (4000, 8000):
        for n in (2, 7, 9):
            for i in range(n):
                assert got[base + n * 100 + i] == [f"Head\nShared words\nOwn {i}"]
    assert [got[6000 + i] for i in range(2)] == [["Own 0"], ["Own 1"]]


def brute_classes(pages):
    """Classes straight from the occurrence vectors of a host's pages."""
    read = [T.page_tokens(p) for p in pages]
    vectors = defaultdict(list)
    for token in set().union(*read):
        vector = tuple(r[token][0] if token in r else 0 for r in read)
        if 2 * sum(map(bool, vector)) > len(pages):
            vectors[vector].append(token)
    out = []
    for vector, tokens in vectors.items():
        if len(tokens) >= T.LEAST_TOKENS:
            there = [n for n in vector if n]
            rows = []
            for t in tokens:
                on = [r[t] for r in read if t in r]
                rows.append({"place": sum(x[1] for x in on) / len(on), "token": t, "chars": sum(x[2] for x in on), "linked": sum(x[3] for x in on)})
            differ = len({p for p, n in zip(pages, vector, strict=True) if n}) > 1
            out.append({"pages": len(there), "least": min(there), "most": max(there), "differ": differ, "tokens": sorted(rows, key=lambda r: (r["place"], r["token"]))})
    return out


def test_classes_are_those_of_the_occurrence_vectors(spark):
    sites = {f"h{n}.example": [plain(i) for i in range(n)] + ([plain(0)] if n % 2 else []) for n in (2, 5, 9)}
    sites["mixed.example"] = [plain(i) if i % 4 else f"<p>odd {i}<p>odd<ul><li>x<li>y{i}</ul>" for i in range(13)]
    rows = [(h, p) for h, pages in sites.items() for p in pages]
    got = {r.host: json.loads(r.template) for r in T.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert set(got) == {*sites, "*"}
    sites["*"] = [p for pages in list(sites.values()) for p in pages]
    for host, pages in sites.items():
        want = T.deduce(brute_classes(pages), len(pages))
        norm = lambda t: {**t, "constant": sorted(t["constant"]), "nested": [sorted(x) for x in t["nested"]]}
        assert norm(got[host]) == norm(want)
    assert any(got["h9.example"]["nested"]) and len(got["h9.example"]["constant"]) == 3


def test_broken_markup_takes_linear_time():
    for page in ('<a href="x ' * 400_000, "<" * 1_000_000, "<div>" * 300_000, "<p class=a>x" * 100_000, "<div '" * 300_000, "<!-- " * 300_000):
        began = time.perf_counter()
        T.extract(page, {})
        assert time.perf_counter() - began < 30
    long = "<article><p>" + "word &lt; " * 500_000 + "<p>end"
    assert T.extract(long, {}) == ("word < " * 500_000).strip() + "\nend"
    deep = "<article>" + "<div>" * 1000 + "in" + "</div>" * 1000 + "<p>out"
    assert T.extract(deep, {}) == "in\nout"
    assert Counter(k for k, *_ in T.markup("<p a='>'>x</p><style><b></style>y")) == {"start": 1, "end": 1, "text": 2, "raw": 1}
