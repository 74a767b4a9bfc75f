import random
import time

import pytest

from maskwright.llm import html_text
from maskwright.llm.html_text import Extractor, Tree, Wrapper, align, main_text, page_tree, parse


def plain_match(a, b):
    """Nodes in the best order-keeping match of two forests, by the recursion that defines simple tree matching."""
    if not a or not b:
        return 0
    best = max(plain_match(a[:-1], b), plain_match(a, b[:-1]))
    if a[-1].label == b[-1].label:
        best = max(best, plain_match(a[:-1], b[:-1]) + 1 + plain_match(a[-1].kids, b[-1].kids))
    return best


def forest(rng, depth):
    out = []
    for _ in range(rng.randrange(5)):
        t = Tree(rng.choice("xyz"))
        t.kids = forest(rng, depth - 1) if depth else []
        out.append(t)
    return out


def matched(a, b, known):
    pairs = align(a, b, known)
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert all(a[i].label == b[j].label for i, j in pairs)
    return sum(1 + html_text.weight(a[i], b[j], {}) - 1 for i, j in pairs)


def test_weights_are_those_of_simple_tree_matching():
    rng = random.Random(4)
    for _ in range(300):
        a, b = forest(rng, 2), forest(rng, 2)
        x, y = Tree("r"), Tree("r")
        x.kids, y.kids = a, b
        assert html_text.weight(x, y, {}) == 1 + plain_match(a, b)
        assert matched(a, b, {}) <= plain_match(a, b)


def test_unlike_neighbours_get_the_best_match():
    rng = random.Random(5)
    for _ in range(300):  # nothing to match at either end, so the grid decides alone
        a, b = ([t] + forest(rng, 1) + [u] for t, u in ((Tree("p"), Tree("q")), (Tree("s"), Tree("t"))))
        assert matched(a, b, {}) == plain_match(a, b)


def test_trees_come_back_from_their_rows():
    tree, _ = page_tree(parse("<body><div><p>a</p><ul><li>b<li>c</ul></div><p>d"))
    assert Tree.load(tree.dump()).dump() == tree.dump() and Tree.load(tree.dump()).shape() == tree.shape()


def extracted(pages):
    wrapper = Wrapper()
    for p in pages:
        wrapper.add(page_tree(parse(p))[0])
    dumped = wrapper.dump()
    return [Extractor().text(p, dumped) for p in pages]


def noisy(i, body):
    return f"<body><div class=one>Our shop of things</div><div class=two><a href=x>Link {i}</a></div><div class=three><div><h1>Head {i}</h1>{body}</div></div><div class=four>Short word {i}</div><div class=five>Imprint of the shop</div>"


def test_the_wrapper_alone_finds_the_text(monkeypatch):
    """No article, no telling names: what varies, where most varies, is the text; one page by itself cannot know."""
    pages = [noisy(i, f"<p>The text of page {i} is long enough to be where most of what varies is, {'on ' * i} and so on and so on.</p><p>Read our terms.</p><p>{i}</p>") for i in range(6)]
    got = extracted(pages)
    assert all(g.startswith(f"Head {i}\nThe text of page {i}") and "Imprint" not in g and "shop" not in g for i, g in enumerate(got))
    assert all(Extractor().text(p, None) != g for p, g in zip(pages, got, strict=True))  # without the wrapper template stays
    monkeypatch.setattr(html_text, "_LEFT_OUT", frozenset("head script style title".split()))
    monkeypatch.setattr(html_text, "_named", lambda tag, attrs: 0)
    assert extracted(pages) == got


def test_names_are_not_needed_on_regular_pages(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("html", "lower(parse_url(url, 'HOST')) AS host").collect()
    hosts = {}
    for r in rows:
        hosts.setdefault(r.host, []).append(r.html)
    named = {h: extracted(p) for h, p in hosts.items()}
    monkeypatch.setattr(html_text, "_LEFT_OUT", frozenset("head script style title".split()))
    monkeypatch.setattr(html_text, "_named", lambda tag, attrs: 0)
    assert {h: extracted(p) for h, p in hosts.items()} == named


def test_template_in_an_article_goes():
    pages = [f"<body><article><h1>Head {i}</h1><p>A text that is long enough to be the larger part of page {i}</p><blockquote>Subscribe now</blockquote></article>" for i in range(5)]
    assert "Subscribe" in Extractor().text(pages[0], None) and not any("Subscribe" in t for t in extracted(pages))


@pytest.mark.parametrize(
    "page",
    [
        lambda i: "<div>" * 10_000 + f"text {i}" + "</div>" * 10_000,
        lambda i: "".join(f"<div>{k} {i} " for k in range(5000)),
        lambda i: "<article>" + "".join(f"<h2>h{k} {i}</h2><p>p {k} {i}</p>" for k in range(2500 - i)),
        lambda i: "<article>" + "".join(f"<div class={'abc'[(k * (i + 2) + k // 3) % 3]}>p {k} {i}</div>" for k in range(5000)),
        lambda i: "<b>" * 5000 + f"<i>{i}" + "<p>" * 5000 + f"word {i}",
    ],
)
def test_deep_and_wide_pages(page):
    pages = [page(i) for i in range(5)]
    began = time.time()
    got = extracted(pages)
    assert time.time() - began < 30
    words = lambda t: t.split()
    assert all(words(g) == words(html_text.re.sub(r"<[^>]*>", " ", p)) for g, p in zip(got, pages, strict=True))


def test_rows_and_columns(spark):
    page = lambda i: f"<body><nav>n</nav><article><h1>Head {i}</h1><p>Body {i}</article>"
    rows = [(i % 3, "http://h/p", page(i % 3), "old", 5, "w") for i in range(9)] + [(9, "http://h/p", None, None, None, None)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, wrapper string")).collect()
    assert sorted((r.page_id, r.text, r.wrapper) for r in got if r.page_id < 9) == sorted((i % 3, f"Head {i % 3}\nBody {i % 3}", "w") for i in range(9))
    assert [(r.text, r.n_chars, r.wrapper) for r in got if r.page_id == 9] == [("", 0, None)]


def test_names_that_text_may_have_stay_in_an_article(spark):
    inside = '<table class="legal"><tr><td>Clause one.</td></tr></table><ul class="form"><li>Water is a form of ice.</li></ul><div class="related"><p>A related matter.</p></div><div class="side"><p>Side by side.</p></div>'
    page = f'<html><body><div class="related"><a href="/x">More news</a></div><article><h1>Title</h1><p>First words of it.</p>{inside}<div class="ad">Buy</div><div class="comments"><p>Me too</p></div></article></body></html>'
    row = main_text(spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")).first()
    assert row.text.split("\n") == ["Title", "First words of it.", "Clause one.", "Water is a form of ice.", "A related matter.", "Side by side."]
