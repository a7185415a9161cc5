import math
import random
import re
from collections import defaultdict

from evenspan.llm import html_text

SCHEMA = "page_id long, url string, html string, host string, low string, path string, m int"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Head</header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- ad -->
<div class="ad big">Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b><br>three&nbsp;&#233;<p>Next<ul><li>item 1<li>item 2</ul><div class="share">Share</div><aside>Side</aside><form>Name</form></article>
<section id="comments"><p>Reader</section><footer>&copy; x</footer></body></html>"""


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "h", "l", "p", 1) for r in rows], SCHEMA)
    return {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}


def test_one_page():
    # the share box of a single page has no page to be compared with; the names of classes say nothing
    assert html_text.Page(PAGE).text() == "A & B\nOne two three é\nNext\nitem 1\nitem 2\nShare"


def test_edges(spark):
    rows = [(1, "http://a.b/c", None), (2, None, ""), (3, "x", "plain &lt;text&gt;"), (4, "http://a.b/d", "<article><p>cut off <b>mid"), (5, "http://a.b/e", "<p>no body</p><nav>m"), (6, "http://a.b/f", "<script>never"), (7, "http://a.b/g", PAGE), (7, "http://a.b/g", PAGE), (8, "u", "<div>" * 3000 + "deep")]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[6] == "" and got[3] == "plain <text>" and got[4] == "cut off mid" and got[5] == "no body" and got[8] == "deep"
    assert got[7].startswith("A & B")
    df = spark.createDataFrame([], SCHEMA)
    assert html_text.extract(df).collect() == []


def test_repeated_parts_of_a_site_go_and_copies_stay(spark):
    page = "<html><body><div class=x1><p>Top of the site</p></div><div class=story><p>Own text {0}</p><p>more {0}</p></div><div class=x2>Same end</div></body></html>"
    rows = [(i, "http://site.org/p", page.format(i)) for i in range(20)]
    got = texts(spark, rows)
    assert all(got[i] == f"Own text {i}\nmore {i}" for i in range(20))
    # exact copies are one page, so their text isn't taken for a template
    same = texts(spark, [(i, "http://copy.org/p", page.format(0)) for i in range(20)])
    assert all("Own text 0" in t for t in same.values())


def test_hosts(spark):
    urls = ["https://User@Ex.org:80/a?b", "http://ex.org", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(html_text.host_of("url")).collect()]
    assert got == ["ex.org", "ex.org", "", ""]


def plain(pages):
    """The texts by the module's definition, with dictionaries over all pages; ``pages``: (page_id, url, html)."""
    read = [(html_text.Page(h), u) if h else None for _, u, h in pages]
    hosts = [(re.match(r"[a-z]+://([^/?#:]*)", u or "") or [0, ""])[1] for _, u, _ in pages]
    n, m = defaultdict(set), defaultdict(set)
    for got, host in zip(read, hosts):
        if got:
            main = got[0].main()
            for _, node, content, kind in got[0].features():
                for h in (host, "*"):
                    n[h, node, content, kind].add(main)
                    m[h, node, kind].add(main)
    out = {}
    for (i, *_), got, host in zip(pages, read, hosts):
        trees = []
        for h in (host, "*") if got else ():
            texts, nodes = {}, {}
            for number, node, content, kind in got[0].features():
                if kind == 0:
                    texts[number] = len(n[h, node, content, 0]), len(m[h, node, 0])
                else:
                    sizes = [len(v) for (a, b, _, k), v in n.items() if (a, b, k) == (h, node, 1)]
                    pages_ = len(m[h, node, 1])
                    nodes[node] = -sum(x / sum(sizes) * math.log(x / sum(sizes)) for x in sizes) / math.log(pages_ + 2), len(sizes), pages_
            trees.append((texts, nodes))
        out[i] = got[0].text(*trees) if got else ""
    return out


def site(seed=1, many=24):
    """Pages without articles: menus, notices with a changing word, boxes and prose; all else is unclassed."""
    rng = random.Random(seed)
    rows = []
    for i in range(many):
        own = [f"Story {i} part {k} " + " ".join(rng.choices("abcdefgh", k=8)) for k in range(rng.randrange(1, 5))]
        menu = "".join(f"<li>Menu {k}" for k in range(6)) + f"<li>You read page {i}"
        body = f"<div><ul>{menu}</ul></div><div class='content no-sidebar'><h2>Same heading</h2>" + "".join(f"<p>{x}" for x in own) + "<p>Same paragraph in each story</div><div class=z9><p>Imprint<p>Terms</div>"
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<html><body>{body}</body></html>", own))
    return rows


def test_the_tree_alone_decides(spark):
    rows = site()
    got = texts(spark, [r[:3] for r in rows])
    for i, _, _, own in rows:
        assert got[i] == "\n".join(["Same heading", *own]), i
    for i, _, page, own in rows:  # without other pages nothing is known of the menu
        assert "Menu 0" in texts(spark, [(i, "u", page)])[i]
        break


def test_equals_the_plain_way(spark):
    rng = random.Random(3)
    rows = [r[:3] for r in site(2, 30)]
    parts = ["<div class=a>Same</div>", "<div class=b{1}><p>{0}</p><p>Often</p></div>", "<ul><li>x<li>y{0}</ul>", "<table><tr><td>{0}<td>t</table>", "<p>Note</p>", "<section><h3>Title</h3><p>{0}</p></section>", "<div><div>Deep</div><div>{1}</div></div>"]
    for i in range(60):
        body = "".join(rng.choice(parts).format(f"own {i} {rng.random()}", rng.randrange(3)) for _ in range(rng.randrange(1, 7)))
        wrap = rng.choice(["{}", "<article>{}</article>", "<main>{}</main>"])
        rows.append((100 + i, f"http://k{rng.randrange(5)}.org/x", f"<body><nav>n</nav>{wrap.format(body)}</body>"))
    rows += [(300 + k, "http://k1.org/x", rows[-1][2]) for k in range(5)] + [(400, None, None), (401, "q", "")]
    got, want = texts(spark, rows), plain(rows)
    assert got == want and sum(html_text.main_text(h, []) != want[i] for i, _, h in rows) > 30  # the trees take part


def test_names_lose_no_article(spark):
    pages = {
        1: ('<div class="content no-sidebar"><p>Text one</p></div>', "Text one"), 2: ('<div class="post comments-open"><p>Text two</p></div>', "Text two"),
        3: ('<article><div class="entry-header"><h1>T</h1></div><p>Body</p></article>', "T\nBody"), 4: ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p>", "Let x=1 hold"),
        5: ('<p class=x">Hello</p>', "Hello"), 6: ("<p title='a>b'>Quoted</p><p data-x=\"1>2\">Too</p>", "Quoted\nToo"), 7: ("<article><p>Own</p><article><p>A reader</p></article></article>", "Own"),
        8: ('<div role="navigation">Menu</div><p>Text</p>', "Text"), 9: ("<div hidden>No</div><h1>Yes</h1>", "Yes"),
    }
    got = texts(spark, [(i, f"http://s{i}.org", h) for i, (h, _) in pages.items()])
    assert got == {i: t for i, (_, t) in pages.items()}


def test_headings_stay_and_near_copies_stay(spark):
    rows = [(i, "http://s.org", f"<div class=c><h1>Chapter</h1><p>own {i}</p></div>") for i in range(12)]
    assert texts(spark, rows) == {i: f"Chapter\nown {i}" for i in range(12)}
    # a third of a host's pages are near copies of one article: that is no majority
    story = [f"<p>paragraph {k} of the story</p>" for k in range(9)]
    rows = [(i, "http://s.org", "<article>" + "".join(story[:-1]) + f"<p>edition {i}</p></article>") for i in range(10)] + [(20 + i, "http://s.org", f"<article><p>other {i}</p></article>") for i in range(20)]
    assert all(texts(spark, rows)[i].count("\n") == 8 for i in range(10))


def test_deep_nesting_is_linear():
    import tracemalloc

    peaks = []
    for depth in (5000, 40_000):
        tracemalloc.start()
        assert html_text.main_text("<div>" * depth + "deep", []) == "deep"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 12 * peaks[0]
