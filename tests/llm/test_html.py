import html
import math
import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li>B</ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>First<br>line<p>Second &lt;x&gt;   a&nbsp;b
c</p><aside>side</aside><ul><li>one<li>two</ul><form><p>form</p></form><table><tr><td>1<td>2</table>
<section id="comments"><p>nice</p></section><p hidden>h</p><p>Last &#233;&euro; 1 < 2 &amp;amp;</p></article>
<footer>&copy; me</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title & more\nFirst line\nSecond <x> a b c\none\ntwo\n1\n2\nLast é€ 1 < 2 &amp;"


def test_odd_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text("plain  text") == "plain text"
    assert H.main_text("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert H.main_text("<div>a<span>b</span><i>c</div>d") == "abc\nd"
    assert H.main_text("<script>x") == H.main_text("<!-- x") == ""
    assert H.main_text("a <b") == "a <b"
    assert H.main_text('<p title="a>b">x</p><P CLASS=AD>y</P>') == "x"
    assert H.main_text("<article>a</article><p>b</p><article>c</article>") == "a\nc"
    assert H.main_text("<main><header>h</header><p>x</p><footer>f</footer></main>") == "h\nx"
    assert H.main_text("<div>" * 3000 + "x") == "x"


def pages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(5))}</p>" for _ in range(i % 4 + 1))
        rows.append((i, f"http://user@Host.example.com:80/{i}", f"<body><div class=top>Always the same</div><div class=text>{body}</div><div class=end><p>All rights</p></div></body>", "x"))
    rows += [(100, "http://other.example.com/", "<body><div class=top>Always the same</div></body>", "x"), (101, None, "<p>no host</p>", "x"), (102, "nonsense", None, "x"), (103, "http://a.b/", "", "x"), (None, "http://a.b/", "<article>a</article>", "x"), (0, rows[0][1], rows[0][2], "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)


def test_style_tree(spark):
    rows, df = pages(spark)
    (row,) = H.judged_nodes(df.withColumn("host", H.host_of(df.url))).collect()
    assert row.host == "host.example.com"
    state = {n.node: n.state for n in row.nodes}
    assert state[node("body", "div.top")] == H.IS_LOW and state[node("body", "div.text", "p")] == H.IS_HIGH and state[node("body", "div.text")] == H.WAY
    out = H.extract(df).collect()
    assert len(out) == len(rows)
    for r in out:
        page = next(h for i, u, h, _ in rows if i == r.page_id and u == r.url)
        if (r.page_id or 0) < 40 and r.page_id is not None:
            assert r.text == "\n".join(re.findall(r"<p>(0\.[^<]*)</p>", page))
    assert {r.page_id: r.text for r in out if r.page_id is None or r.page_id >= 100} == {100: "Always the same", 101: "no host", 102: "", 103: "", None: "a"}


def node(*names):
    found = 0
    for name in names:
        found = H.hash_of(str(found), name)
    return found


def test_empty(spark):
    _, df = pages(spark)
    assert H.extract(df.where("false")).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in H.extract(df).orderBy("page_id").collect()]


def test_importance_decides_in_and_around_the_article(spark):
    """Boilerplate of neutral classes in the article goes, body text outside of a small article stays."""
    inside = [f"<body><article><div class=lead>Read our story</div><p>body {i} {i * i}</p><div class=tail>All rights</div></article></body>" for i in range(8)]
    assert extracted(spark, inside) == [f"body {i} {i * i}" for i in range(8)]
    around = [f"<body><article class=card>teaser {i}</article><div class=story>the long body of page {i}</div><div class=tail>All rights</div></body>" for i in range(8)]
    assert extracted(spark, around) == [f"teaser {i}\nthe long body of page {i}" for i in range(8)]
    assert extracted(spark, around[:1]) == ["teaser 0\nthe long body of page 0\nAll rights"]


def test_constant_label_does_not_cut_what_is_under_it(spark):
    pages = [f"<body><article>By us<p>body {i}</p></article></body>" for i in range(8)]
    pages[3] = pages[3].replace("</article>", "<blockquote>once</blockquote></article>")
    assert extracted(spark, pages) == [f"body {i}" + "\nonce" * (i == 3) for i in range(8)]


def test_ids_that_are_slugs():
    assert H.main_text('<article><h2 id="social-impact">Social</h2><p class="notice-period">a</p><section id="advertising-history">b</section></article>') == "Social\na\nb"
    assert H.main_text('<article><h2 id="related-work">Related work</h2><p>a</p><h2 id="comments">C</h2><section id="cookie-notice-law"><p>b</p></section><section id=advertising><p>c</p></section></article>') == "Related work\na\nC\nb\nc"
    assert H.main_text('<p>a</p><div id="cookie-banner">b</div><section id=comments>c</section>') == "a"


def test_copies_count_once(spark):
    """Copies of a page, whatever their scripts and comments, don't make its text low, nor that of the host's other pages."""
    page = "<body><script>n({})</script><!-- {} --><div class=top>Always the same</div><div class=text>body {}</div></body>"
    mostly = [page.format(i, i, max(0, i - 30)) for i in range(40)]
    assert extracted(spark, mostly) == [f"body {max(0, i - 30)}" for i in range(40)]
    assert extracted(spark, mostly[:30]) == ["Always the same\nbody 0"] * 30


def test_odd_tags_take_no_longer_than_their_pages():
    began = time.perf_counter()
    for n in (20, 100_000):
        assert H.main_text("x <a " + '""' * n) == "x <a " + '""' * n
        assert H.main_text('<a b="' + '""' * n + "x>y</a>") in ("y", "")
        assert H.main_text("<a " * n) == ("<a " * n).strip()
        assert H.main_text("<!" * n) == "<!" * n
        assert H.main_text("<div>" * n + "x") == "x" and H.main_text("<span>" * n + "<p>x<p>y") == "x\ny"
        assert H.main_text("<p>" * n + "x") == "x" and H.main_text("<span><li>" * n + "x") == "x"
        assert H.main_text("<script>" * n) == "" and H.main_text("</div>" * n + "x") == "x"
        assert H.main_text("a&#" + "9" * n + ";b") == "a\ufffdb" and H.main_text("&#x41;&#0000066;") == "AB"
        H.contents("<div>" * n + "x")
    assert time.perf_counter() - began < 60


def random_page(rng, i):
    """[(tag, class, children)]: a menu, boilerplate, varying text, and rare nodes, in nested elements of neutral names."""
    def word():
        return f"w{rng.randrange(10**6)}"

    def rows(depth):
        out = []
        for k in range(rng.randint(1, 3)):
            what = rng.randrange(5)
            if what == 0:
                out.append(("p", "fixed", [f"always {k}"]))
            elif what == 1:
                out.append(("p", "own", [word()]))
            elif what == 2 and depth:
                out.append(("div", f"d{k}", rows(depth - 1)))
            elif what == 3 and i == 3:
                out.append(("p", f"rare{rng.randrange(3)}", [word()]))
            else:
                out.append(("div", "comments", [("p", "", [word()])]))
        return out

    return [("div", "top", ["Site", *rows(1)]), ("div", "mid", rows(2)), ("div", "end", ["Rights", ("p", "rare", ["x"])] if i % 9 == 0 else ["Rights"])]


def rendered(children):
    return "".join(c if isinstance(c, str) else f'<{c[0]} class="{c[1]}">{rendered(c[2])}</{c[0]}>' for c in children)


def brute_force(pages):
    """Main texts, by the definition: chains of names, entropies over distinct pages, cuts."""
    name = lambda c: f"{c[0]}.{c[1]}" if c[1] else c[0]

    def walk(children, chain, marked, out):
        run = []
        for c in [*children, None]:
            if isinstance(c, str):
                run.append(c)
                continue
            if run:
                out.append(("text", chain, marked, "".join(run)))
                run = []
            if c:
                inner = (*chain, name(c))
                bad = marked or c[1] == "comments"
                out.append(("node", inner, bad, " ".join(name(x) for x in c[2] if not isinstance(x, str))))
                walk(c[2], inner, bad, out)
        return out

    walks = [walk(p, ("body",), False, []) for p in pages]
    distinct = {str([x for x in w if not x[2]]): w for w in sorted(walks, key=str, reverse=True)}
    measured = {}
    for w in distinct.values():
        each = {}
        for kind, chain, _, what in w:
            each.setdefault((chain, kind), []).append(what)
        for (chain, kind), what in each.items():
            if (chain, kind) != (("body",), "node"):
                measured.setdefault(chain, {}).setdefault(kind, []).append(tuple(what))
    low, high, lead = set(), set(), set()
    for chain, kinds in measured.items():
        entropies = []
        for what in kinds.values():
            if (m := len(what)) >= H.MIN_PAGES:
                entropies.append(-sum(c / m * math.log(c / m) for c in Counter(what).values()) / math.log(m))
        if len(kinds.get("text", ())) >= H.MIN_PAGES:
            (low if max(entropies) < H.LOW else high).add(chain)
    for chain in high:
        if "div.comments" not in chain:
            lead |= {chain[:k] for k in range(1, len(chain))}
    branches = low - lead
    out = []
    for w in walks:
        out.append("\n".join(t for kind, chain, bad, t in w if kind == "text" and not bad and (chain in high or chain not in low and not any(chain[:k] in branches for k in range(1, len(chain) + 1)))))
    return out


def test_against_brute_force(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pages = [random_page(rng, i) for i in range(30)]
        pages += [pages[0]] * 20 + [pages[3]]
        assert extracted(spark, [f"<body>{rendered(p)}</body>" for p in pages]) == brute_force(pages)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_boilerplate_put_into_the_pages_table(spark):
    """Whatever a site puts on all its pages under neutral names goes, in the article and around it, and nothing else does."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    put = [(r.page_id, r.url, r.html.replace("<article>", '<div class="x1">Our site</div><article><div class="x2">Read us <b>daily</b></div>').replace("</article>", "<p class=x3>Written by us</p></article>")) for r in pages]
    schema = "page_id long, url string, html string"
    before, after = (spark.createDataFrame(rows, schema).repartition(4) for rows in (pages, put))
    judged = {r.host for r in H.judged_nodes(after.withColumn("host", H.host_of(after.url))).collect() if node("html", "body", "article", "div.x2") in H.Judged([tuple(n) for n in r.nodes]).low}
    want = {r.page_id: r.text for r in H.extract(before).collect()}
    checked = 0
    for r in H.extract(after).withColumn("host", H.host_of(F.col("url"))).collect():
        if r.host in judged:
            assert r.text == want[r.page_id]
            checked += 1
        else:
            assert "Read us daily" in r.text
    assert checked > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_articles_of_the_pages_table(spark):
    """Each page's text is that of its article's blocks, as a plain pattern finds them."""
    found = {r.page_id: r.text for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<br ?/?>", " ", x)).replace("\x00", "").split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article)))
        assert found[r.page_id] == "\n".join(x for x in lines if x), r.page_id
