"""Operators over pages on small tables with odd rows."""

from __future__ import annotations

import random

from attnstrata.llm import html_text, url_filter


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, text int")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header>Site name</header><div class="ad">Buy this now</div>
<article><h1>Head &amp; line</h1><p><b>First  paragraph
goes on.<br><p>Second &lt;one&gt;<aside>not this</aside><p>Third.</p><form>Name <input></form></article>
<div class="comments"><p>Reader says a lot of things here, more than eighty characters of them, to be sure of it.</p></div>
<footer>&copy; site</footer></body>"""


def test_main_text_of_pages(spark):
    rows = [
        (1, "http://a/", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>short</p>"), (5, "u", "<nav><a href=x>only menu</a></nav>"),
        (6, "u", "<div>" + "long text of a page without an article element " * 3 + "</div><ul><li><a href=1>link one</a></li></ul>"),
        (1, "http://a/", PAGE), (8, "u", "<p>unclosed <b>tag & <"), (9, "u", "<p>" * 3000 + "deep"),
    ]
    got = html_text.op5(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "Head & line\nFirst paragraph goes on.\nSecond <one>\nThird."
    assert by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == by[5]["text"] == "" and by[2]["n_chars"] == 0
    assert by[None]["text"] == "short"
    assert by[6]["text"] == ("long text of a page without an article element " * 3).strip()
    assert by[8]["text"] == "unclosed tag & <" and by[9]["text"] == "deep"
    assert html_text.op5(pages(spark, []).limit(0)).collect() == []


def test_articles_keep_linked_text_and_what_follows_unclosed_elements():
    cases = {
        "<h1><a href=x>Title</a></h1><p>Text</p>": "Title\nText",
        "<p><a href=x>A linked paragraph</a></p><p>Text</p>": "A linked paragraph\nText",
        "<p>Text</p><ul><li><a href=x>one</a> <a href=y>two</a></li></ul>": "Text\none two",
        "<header><h1>Title</h1></header><p>Text</p><footer>By me</footer>": "Title\nText",
        "<p class='related-work'>Text</p><p id=search>More</p><p class=ad-free>Last</p>": "Text\nMore\nLast",
        "<div class='site-header'>Nav</div><div class='ad_box'>Buy</div><div class=non-ad-text>Text</div>": "Nav\nText",
        "<p>Text</p><section class=comments><article><p>A reply</p></article></section><p>More": "Text\nMore",
        "<p class='ad'>Buy<p>Text</p><p>More</p>": "Text\nMore",
        "<div><p class=ad>Buy</div><p>Text</p>": "Text",
        "<p class=ad>Buy <b>now</b></p><p>Text</p>": "Text",
        "<ul><li class=social>Share<li>Item</ul><p>More</p>": "Item\nMore",
        "<ul><li class=social>Share<ul><li>a<li>b</ul>c</ul><p>More</p>": "More",
        "<dl><dt class=ad>Buy<dd>Text</dl>More": "Text\nMore",
        "<table><tr><td class=ad>Buy<td>Cell<tr class=ad><td>x<td>y<tr><td>Last</table>More": "Cell\nLast\nMore",
        "<div class=ad><p>a<div>b</div>c</div><p>Text": "Text",
    }
    for inside, text in cases.items():
        assert html_text.main_text(f"<body><article>{inside}</article></body>") == text, inside


LONG = "a long line of an article without any mark of it, " * 4


def test_surge_and_dive_decide_without_an_article_element():
    long = LONG.strip()
    pages = {
        # menus and notes before and behind the text are apart from it by lines that weigh nothing, and do not surge
        f"<nav><a href=x>Menu</a></nav><div>Home</div><nav>x</nav><h1>Title</h1><p>{LONG}</p><p>Short.</p><footer>f</footer><div>Cookies</div>": f"Title\n{long}\nShort.",
        # a surge that is small beside the page's largest
        f"<p>{LONG}</p><nav>x</nav><div>{'note ' * 20}</div><nav>x</nav><p>{LONG * 3}</p>": f"{long}\n{(LONG * 3).strip()}",
        f"<p>{LONG * 5}</p><nav>x</nav><div>{'note ' * 20}</div>": (LONG * 5).strip(),
        # an aside inside the text does not end it
        f"<p>{LONG}</p><aside>not this</aside><p>Behind.</p><ul><li><a href=x>menu</a></li></ul><p>End.</p>": f"{long}\nBehind.\nEnd.",
        # a card is an article element, but not the article
        f"<article>Card</article><div class=post><h1>Title</h1><p>{LONG}</p></div>": f"Title\n{long}",
    }
    for page, text in pages.items():
        assert html_text.main_text(f"<body>{page}</body>") == text, page


def test_the_step_changes_results():
    """Without sums, all lines that weigh something would stay."""
    page = f"<div>Home</div><nav>x</nav><p>{LONG}</p><footer>f</footer><div>All rights</div>"
    found = html_text.lines(page)
    assert [t for t, _ in found if t] == ["Home", LONG.strip(), "All rights"] and html_text.main_text(page) == LONG.strip()


def test_sums_against_plain_ones():
    rng = random.Random(3)
    for _ in range(400):
        sizes = [rng.choice([0, 0, 0, 5, 30, 60, 200]) for _ in range(rng.randrange(25))]
        total = lambda i: sum(sizes[i : i + html_text.WINDOW])  # noqa: B023, E731
        want, i = [], 0
        while i < len(sizes):
            if sizes[i] and total(i) > html_text.SURGE:
                end = next((j for j in range(i, len(sizes)) if total(j) == 0), len(sizes))
                want.append((i, end, max(total(j) for j in range(i, end))))
                i = end
            i += 1
        assert html_text.stretches(sizes) == want


def test_very_long_pages():
    page = f"<article>{'<p>word</p>' * 50000}</article>"
    assert html_text.main_text(page) == "\n".join(["word"] * 50000)
    assert html_text.main_text("<div>" * 20000 + LONG) == LONG.strip()


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = []
    for rule, _ in url_filter.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append(rule)
    return max(fits, key=len, default=None)


def test_rules_and_verdicts_of_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "http://example.org", "http://example.org/en/12?x#y", "http://a.example.org/en/2",
        "https://xcom/fr/", "https://x.com/fr/1", "https://x.com/de/", "https://x.com/de", "https://É.com/de/", "http://a?b/c", "http://a#b", "x://y://z/w",
        "http://cheap-pills.example.net/en/1", "http://blog.reading.example.net/en/1", "http://org/", "http://casino-win.example.net/?q",
    ]
    got = url_filter.judge(pages(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()
    verdicts = dict(url_filter.RULES)
    assert len(got) == len(urls)
    for r in got:
        host, path = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == brute_rule(host, path)
        assert r["verdict"] == verdicts.get(r["rule"], "block" if r["score"] > 0.5 else "allow")
    by = {urls[r["page_id"]]: r["verdict"] for r in got}
    assert by["http://cheap-pills.example.net/en/1"] == by["http://casino-win.example.net/?q"] == "block"
    assert by["http://blog.reading.example.net/en/1"] == by[None] == "allow"
