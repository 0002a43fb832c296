import math
import random
from collections import Counter

from gradeloom.llm.site_style import extract, importance, main_text, style_nodes


def test_semantic_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <div id="cookie-notice">cookies</div><article><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &amp; &#233;&#x41;<br>two
    three<p>four<ul><li>a<li>b</ul><form>mail <input></form><div class="share">share</div><aside>see also</aside>
    <table><tr><td>x<td>y</table></p><section class="comments"><p>first!</p></section></article><div class="sidebar"><p>more</p></div>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head line One bold & éA two three four a b x y"


def test_malformed():
    assert main_text("") == "" and main_text("just text") == "just text"
    assert main_text("<p>a<p>b</div></b>c") == "a bc"
    assert main_text("<article><p><b>x<br><p>y</article><footer>z</footer>") == "x y"
    assert main_text("<div>1 < 2 &amp;lt; 3 <script>never closed") == "1 < 2 &lt; 3"
    assert main_text("<p title='a>b' class=\"x\">q</p><") == "q <"
    assert main_text("<p title='open>x</p><p>y</p>") == "x y"
    assert len(main_text("<div>" * 5000 + "deep")) == 4


def brute(rows):
    out = {}
    for host, path in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if r[:2] == (host, path)]
        m = len(own)
        def h(k):
            return -sum(n / m * math.log(n / m, m) for n in Counter(r[k] for r in own).values()) if m > 1 else 1.0
        g = 0.9 ** len({r[2] for r in own})
        out[host, path] = (m, (1 - g) * h(2) + g * h(3) if m > 1 else 1.0)
    return out


def site(rng, n):
    for i in range(n):
        words = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(60))
        yield f"<html><body><div class='top'><span>Shop</span> Home</div><div class='story'><p>{words} {i}</p></div><div class='low'>call {rng.choice('12')}</div></body></html>", f"{words} {i}"


def test_repeating_branches_go_and_stories_stay(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k, (page, story) in enumerate(site(rng, 60)):
        rows.append((k, f"http://a.example/{k}", page))
        want[k] = story
    copies = [(100 + k, f"http://b.example/{k}", "<body><nav>m</nav><article><p>the same story</p></article></body>") for k in range(30)]
    odd = [(200, None, None), (201, "", "<p>lone</p>"), (202, "no host", ""), (200, None, None), (None, "http://a.example/q", rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows + copies + odd], "page_id long, url string, html string, host string")
    got = extract(df).collect()
    assert len(got) == 95
    by = {r.page_id: r.text for r in got}
    assert all(by[k] == want[k] for k in want)
    assert all(by[100 + k] == "the same story" for k in range(30))
    assert by[200] == by[202] == "" and by[201] == "lone" and by[None] == want[0]


def test_importance_against_brute_force(spark):
    rng = random.Random(5)
    pages = [(rng.choice(["a", "b", ""]), p.replace("<p>", rng.choice(["<p>", "<ul><li>x</ul><p>"]))) for p, _ in site(rng, 40)]
    nodes = style_nodes(spark.createDataFrame(pages, "host string, html string"))
    rows = [tuple(r) for r in nodes.collect()]
    want = brute(rows)
    got = {(r.host, r.path): (r.pages, r.importance) for r in importance(nodes).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_branches_inside_and_outside_of_articles(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k, (_, story) in enumerate(site(rng, 40)):
        rows += [
            (k, f"http://a.example/{k}", f"<body><article><p>Staff</p><p>{story}</p><div class='box'>call us today</div></article></body>"),
            (100 + k, f"http://b.example/{k}", f"<body><article class='card'><b>teaser</b></article><div class='text'><p>{story}</p></div></body>"),
            (200 + k, f"http://c.example/{k}", f"<body><div class='layout has-sidebar'><div class='sidebar'>more</div><main><p>{story}</p></main></div></body>"),
            (300 + k, f"http://d.example/{k}", "<body><div class='wrap'><article><p>the same story</p></article></div></body>"),
        ]
        want |= {k: f"Staff {story}", 100 + k: f"teaser {story}", 200 + k: story, 300 + k: "the same story"}
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
