import random

import numpy as np

from tracklore.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy <b>now</b></div><div class="cookie-notice">Cookies</div>
{0}<aside>Side</aside><section id="comments"><article class="comment"><p>First!</p></article></section><form><input name=q>Find</form><footer>&copy; me</footer></body></html>"""


def texts(pages):
    return [he.text_of(p, np.zeros(0, np.int64)) for p in pages]


def test_article_is_kept_and_the_rest_goes():
    body = "<article class='post'><header class='entry-header'><h1>Head &eacute;</h1></header><p><b>One <br><p>two&nbsp; th<i>re</i>e &lt;x&gt; &amp;am</p><div class='share'>Tweet</div><aside>more</aside><p>4 &#x41;</article>"
    assert texts([PAGE.format(body)]) == ["Head é One two three <x> &am 4 A"]
    assert texts([PAGE.format("<main><p>In main</p></main>")]) == ["In main"]
    assert texts(["", "   ", "<p", "a < b", "<article>", "<article>open <p>text<footer>f"]) == ["", "", "", "a < b", "", "open text"]
    assert texts(["<div class='ad'>open <article>in</article> out"]) == ["in"]
    assert texts(["<article><p class=notice>n<p>kept</article>"]) == ["kept"]


def draw(r, k):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(k))


def test_boilerplate_equals_brute_force():
    r = random.Random(2)
    passage = [f"p{i}" for i in range(20)]
    streams = []
    for i in range(12):
        s = [r.choice("abc") if r.random() < 0.5 else f"u{r.randrange(5000)}" for _ in range(r.randint(0, 120))]
        k = r.randint(0, len(s))
        streams.append(s[:k] + (passage[r.randint(0, 9) :] if i % 2 else []) + s[k:])
    n, where = he.LONG, {}
    for k, s in enumerate(streams):
        for i in range(len(s) - n + 1):
            where.setdefault(tuple(s[i : i + n]), set()).add(k)
    known = he.boilerplate([he.codes_of(s) for s in streams])
    hits = 0
    for s in streams:
        want = np.zeros(len(s), bool)
        for i in range(len(s) - n + 1):
            if len(where[tuple(s[i : i + n])]) >= max(he.FEWEST, he.SHARE * len(streams)):
                want[i : i + n] = True
        assert (he.covered(he.codes_of(s), known) == want).all()
        hits += want.sum()
    assert hits
    assert len(he.boilerplate([])) == len(he.boilerplate([he.codes_of([])] * 5)) == 0


def test_array_decides_inside_and_outside_of_articles(spark, monkeypatch):
    r = random.Random(3)
    top, bottom, box = draw(r, 15), draw(r, 15), draw(r, 12)
    own = [draw(r, 40) for _ in range(60)]
    bare = "<html><body><div>{0}</div><div><p>{2}</p></div><div>{1}</div></body></html>"
    marked = "<html><body><article><p>{2}</p><div><p>{3}</p></div><p>end {4}</p></article></body></html>"
    quote = draw(r, 20)  # on a tenth of the pages: no boilerplate
    rows, want = [], {}
    for i, t in enumerate(own):
        form = bare if i % 2 else marked
        rows.append((i, "http://one.example/" + str(i), form.format(top, bottom, t + (f" {quote}" if i % 10 == 0 else ""), box, i)))
        want[i] = t + (f" {quote}" if i % 10 == 0 else "") + ("" if i % 2 else f" end {i}")
    twin = draw(r, 50)  # versions of one article are no boilerplate, though all pages hold it
    for i in range(100, 110):
        rows.append((i, "http://two.example/", f"<article><h1>v {i}</h1><p>{twin}</p></article>"))
        want[i] = f"v {i} {twin}"
    rows += [(i + 1000, u, h) for i, u, h in rows[:20]]  # equal pages
    want |= {i + 1000: want[i] for i in range(20)}
    for run, parts in ((2_000_000, 2), (2_000_000, 9), (4_000, 5)):  # one bucket and several, any partitioning
        monkeypatch.setattr(he, "RUN", run)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {x.page_id: x.text for x in he.main_text(df).collect()} == want


def test_a_very_long_page(spark):
    t = draw(random.Random(5), 60_000)
    df = spark.createDataFrame([(1, "http://h/", f"<article><p>{t}</article>")], "page_id long, url string, html string")
    assert he.main_text(df).first().text == t


def test_query_form(spark):
    body = "<article><p>text {}</p></article>"
    rows = [(i, f"https://user@Host{i % 2}.org:80/x{i}", PAGE.format(body.format(i)), "k", 7) for i in range(30)] + [(30, None, None, "k", 7), (None, "http://h/", "", "k", 7), (3, "http://h/", PAGE.format(body.format("é😀")), "k", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, id int")
    got = he.main_text(pages).collect()
    assert len(got) == len(rows)
    by = sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in got)
    assert by[0] == (-1, "", 0) and (3, "text é😀", 7) in by and (3, "text 3", 6) in by and (30, "", 0) in by
    assert he.main_text(pages.limit(0)).collect() == []
