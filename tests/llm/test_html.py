"""The HTML extractor: odd markup, long pages, and differencing against a plain longest common subsequence."""

import time
from collections import Counter

import numpy as np
import pytest

from weftspark.llm import html_text

PAGES = "page_id long, url string, html string, text string, host int, part int"


def text(page):
    return html_text.main_text(*html_text.blocks(page), None)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>one<button>x<p>two</p><p>three</p></article>", "one|two|three"),
        ("<article><p>one<button>x</button> two<p>three</article>", "one two|three"),
        ("<article><select><option>a<p>two</article>", "two"),
        ("<article><p>q<iframe>z<p>r</article>", "qz|r"),
        ("<noscript>n</noscript><template><p>t</template><p>y", "y"),
        ("<article><div class='search-results'><p>kept</p></div><p id='share-of-market'>also</p></article>", "kept|also"),
        ("<article><div class='ad'><p>no</p></div><div id='comments-list'>no</div><p>yes</article>", "yes"),
        ("<nav><a>menu</a><article><p>text</article>", "text"),
        ("<div class=ad>Buy<article>text</article></body>", "text"),
        ("<form><article><header><h1>T</h1><p>by</header><p>x</article></form>", "T|x"),
        ("<article><p>a <span class='ad'>no</span> b</p></article>", "a b"),
        ("<article><p>a <span class='ad'>no</article>", "a"),
        ("<p>1 < 2 <b title='>'>&eacute;&#8217;&notit; &amp;lt;</b>", "1 < 2 é’¬it; &lt;"),
        ("<p>a<!-- never ended <p>b", "a"),
        ("<aside><article>teaser</article></aside><article>x</article>", "x"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, want):
    assert text(page).replace("\n\n", "|") == want


@pytest.mark.parametrize("part", ["<a ", "</b>", "<b>", "<a b=\"", "<!--", "<title>", "<button>", "<li>", "<div class=ad>", "<p>x</p>", "<script", "<p class='", "&amp;"])
def test_long_pages_take_linear_time(part):
    began = time.process_time()
    html_text.blocks(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 3


def plain(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("matches", [html_text.MATCHES, 10])
def test_common_lines_are_longest(monkeypatch, matches):
    monkeypatch.setattr(html_text, "MATCHES", matches)
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = ([str(x) for x in rng.integers(0, rng.integers(2, 12), rng.integers(0, 40))] for _ in range(2))
        got = [a[i] for i in sorted(html_text.common(a, b))]
        at = iter(b)
        assert all(x in at for x in got) and len(got) == plain(a, b)


def test_repeated_lines_take_little_time():
    began = time.process_time()
    assert len(html_text.common(["x", "y"] * 10_000, ["y", "y", "x"] * 7_000)) > 10_000
    assert time.process_time() - began < 20


def test_hinted_lines_of_an_article_are_settled_by_the_neighbour():
    page = lambda desk, *own: html_text.blocks("<article><p>Shared passage.</p><h1>News</h1>" + "".join(f"<p>{x}</p>" for x in own) + f"<div class='author-related'>{desk}</div><p>All rights reserved.</p></article>")
    (a, zones), (b, _), (c, _) = page("By the desk", "one", "two"), page("By the desk", "three"), page("By another", "four")
    assert html_text.main_text(a, zones, b) == "Shared passage.\n\nNews\n\none\n\ntwo\n\nAll rights reserved."
    assert html_text.main_text(a, zones, c) == html_text.main_text(a, zones, None) == "\n\n".join(a)


def by_definition(rows):
    """Every page against the nearest on its host whose lines differ, without ranges."""
    hosts: dict = {}
    for page, url, html in rows:
        u = url or ""
        host, _, path = u.partition("://")[2].partition("/") if "://" in u else ("", "", "")
        hosts.setdefault(host.lower(), []).append((("/" + path if path else "").split("?")[0].split("#")[0], u, -1 if page is None else page, *html_text.blocks(html)))
    out = []
    for own in hosts.values():
        own.sort(key=lambda r: (r[0].encode(), r[1].encode(), r[2]))
        for i, (path, u, page, lines, zones) in enumerate(own):
            left = next((own[j] for j in range(i - 1, -1, -1) if own[j][3] != lines), None)
            right = next((own[j] for j in range(i + 1, len(own)) if own[j][3] != lines), None)
            near = sorted((x for x in (left, right) if x), key=lambda x: -html_text._shared_start(x[0], path))
            out.append((page, html_text.main_text(lines, zones, near[0][3] if near else None)))
    return Counter(out)


@pytest.mark.parametrize("span", [html_text.RANGE, 20_000, 1])
def test_ranges_change_nothing(spark, monkeypatch, span):
    monkeypatch.setattr(html_text, "RANGE", span)
    rng, rows = np.random.default_rng(2), []
    for i in range(160):
        host, path = f"h{rng.integers(0, 4)}.test", f"s{rng.integers(0, 6)}/{rng.integers(0, 30)}"
        shared = "".join(f"<div>line {k}</div>" for k in rng.choice(6, rng.integers(0, 5), replace=False))
        own = "" if rng.random() < 0.2 else f"<p>own {rng.integers(0, 60)}</p>"
        body = shared + own + "<div>End</div>"
        rows.append((i, f"http://{host}/{path}", f"<article>{body}</article>" if rng.random() < 0.3 else body))
    rows += [(500, None, "<p>no url</p>"), (None, "http://h1.test/s1/x", "<p>no id</p>"), (501, "http://h1.test/s1/x", None), rows[3], rows[3], (502, "no scheme", "<p>odd</p>"), (503, "http://h2.test/long", "<p>word " * 200_000)]
    pages = spark.createDataFrame([(*rows[i], "t", 1, 2) for i in rng.permutation(len(rows))], PAGES)
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert Counter((-1 if r.page_id is None else r.page_id, r.text) for r in found) == by_definition(rows)
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract(pages.limit(0)).count() == 0
