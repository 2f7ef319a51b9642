"""Main-text extraction: given pages, hand-made pages, a site without telling mark-up, and the tree's figures."""

import html
import math
import re
from collections import defaultdict

import pytest

from cellguard.llm import registry, styletree

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, low int, host int, text int, node int"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    return sorted(((r["page_id"], r["text"], r["n_chars"]) for r in styletree.extract(df).collect()), key=str)


def test_given_pages_keep_their_articles_whole(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    want = {}
    for r in pages:
        inner = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())
                  for b in re.split("</?(?:p|h1)>", inner.replace("<b>", "").replace("</b>", ""))]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r for r in registry.op13_style_tree(spark, SMALL).collect()}
    assert {k: v["text"] for k, v in got.items()} == want
    assert all(v["n_chars"] == len(want[k]) for k, v in got.items())
    assert len(got) == len(pages)


MARKED = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site name</a></header><nav><ul><li>Home<li>News</ul></nav>
<div id="cookie-notice">We use cookies</div><aside>Side</aside><div class="ad">Buy</div>
<main><article><header class="entry-header"><h1>Big &lt;news&gt;</h1></header><p>First&nbsp;one
  <b>bold</b> t<i>ex</i>t.<p>Second 1 < 2 &amp; 3&#33;<br>next line<ul><li>a<li>b</ul><span class="share">Tweet <span>x</span></span>
<p>Third<!-- gone --> one.</p><form><p>Your name</p><input></form><div class="ad">Buy more</div><table><tr><td>c1<td>c2</table>
<footer>By us</footer></article><section id="comments"><article class="comment"><p>Nice!</p></article></section></main>
<footer>(c) us</footer><noscript>No script</noscript></body></html>"""
MARKED_TEXT = "Big <news>\nFirst one bold text.\nSecond 1 < 2 & 3! next line\na\nb\nThird one.\nc1\nc2"

PLAIN_CASES = [
    (None, ""), ("", ""), ("   \n", ""), ("just  text", "just text"), ("<p>a<p>b", "a\nb"), ("a <b", "a"),
    ("x <!-- never closed <p>y", "x"), ("<div>a</div></p></div>b", "a\nb"), ("<script>if (a<b) {}", ""),
    ("<SCRIPT>x</ScRiPt ><P>ok</P>", "ok"), ("<p title='>'>q</p>", "q"), ("<p title='>q</p>", "q"),
    ("&lt;p&gt; &copy &unknown; &#x41;", "<p> \u00a9 &unknown; A"), ("<nav>only a menu</nav>", ""),
    ("<main><p>m</p></main><p>out</p>", "m"), ("<div role='main'>r</div><p>out</p>", "r"),
    ("<article class='teaser comment'>c</article><p>text</p>", "text"), ("<p hidden>h</p><p>s</p>", "s")]


def test_hand_made_pages(spark):
    rows = [(i, f"https://only{i}.example/x", page) for i, (page, _) in enumerate(PLAIN_CASES)]
    rows += [(900, "http://m.example/1", MARKED), (901, None, MARKED), (901, None, MARKED), (None, "no host", "<p>z</p>"),
             (902, "https://long.example/", "<p>" + "word &amp; " * 300_000 + "</p>")]
    want = [(i, t, len(t)) for i, (_, t) in enumerate(PLAIN_CASES)]
    want += [(i, MARKED_TEXT, len(MARKED_TEXT)) for i in (900, 901, 901)] + [(None, "z", 1)]
    long = " ".join(["word &"] * 300_000)
    assert texts(spark, rows) == sorted([*want, (902, long, len(long))], key=str)
    assert texts(spark, []) == []


def site(n):
    """Pages whose classes say nothing: the tree alone can tell the frame from the story."""
    for i in range(n):
        story = "".join(f"<div class=s{j}>Story {'abcdefghij'[i % 10]}{chr(97 + i // 10)} part {'xyz'[j]}.</div>" for j in range(3))
        yield (i, f"https://SITE.example:80/{i}", f"<div class=t1><div>Home</div><div>About {i}</div></div><div class=k>{story}"
               f"<div class=q>Read on at our partners</div></div><div class=b>All rights with us, {2000 + i}</div>")


def test_the_tree_finds_what_pages_of_a_site_repeat(spark):
    rows = list(site(40))
    got = texts(spark, rows)
    for i, text, _ in got:
        name = "abcdefghij"[i % 10] + chr(97 + i // 10)
        assert text == "\n".join(f"Story {name} part {p}." for p in "xyz")
    alone = texts(spark, rows[:1])  # one page is no evidence
    assert alone[0][1].startswith("Home\nAbout 0\nStory aa") and "partners" in alone[0][1]


def test_copies_of_an_article_stay(spark):
    page = "<nav>Menu</nav><article><h1>Same</h1><p>Same words on each.</p><div>Other part</div></article>"
    rows = [(i, "http://copies.example/", page) for i in range(30)]
    assert {t for _, t, _ in texts(spark, rows)} == {"Same\nSame words on each."}
    bare = [(i, "http://copies.example/", "<div class=x1><div>One text</div><div>Two</div></div>") for i in range(30)]
    assert {t for _, t, _ in texts(spark, bare)} == {"One text\nTwo"}  # nothing would stay, so all does


def test_importance_against_plain_entropies(spark):
    rows = list(site(25)) + [(100 + i, "http://other.example", f"<p>Line {'ab'[i % 2]} <i>x</i></p><div>{'<b>y</b>' * (i % 3)}z</div>")
                             for i in range(9)]
    by = defaultdict(list)
    for _, url, page in rows:
        blocks = styletree.Page(page).blocks
        for node in {b.node for b in blocks}:
            own = [b for b in blocks if b.node == node]
            by[styletree.host_of(url), styletree.key(node)].append(
                ({re.sub(r"\d+", "0", b.text) for b in own}, tuple(b.inline for b in own)))
    want = {}
    for at, shown in by.items():
        m = len(shown)
        said = {t for s, _ in shown for t in s}
        entropy = [math.log(sum(t in s for s, _ in shown)) / math.log(m) for t in said]
        looks = [sum(x == y for _, x in shown) / m for y in {x for _, x in shown}]
        presentation = -sum(p * math.log(p) / math.log(m) for p in looks)
        damped = 0.9 ** len(looks)
        want[at] = (1 - damped) * presentation + damped * (1 - sum(entropy) / len(entropy))
    got = {(r["host"], r["node"]): r["importance"] for r in styletree.style_tree(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.keys() == want.keys()
    for at, value in want.items():
        assert got[at] == pytest.approx(value, abs=1e-9)
