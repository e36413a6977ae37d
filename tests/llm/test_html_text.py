import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest

from concord.llm import html_text
from concord.llm.dom import name_tokens, parse
from concord.llm.html_pages import MARK, marked_page

LONG = "This is the first paragraph of the story, and it goes on for some time. It says a few things, then ends."
ARTICLE = f"<article><h1>A title</h1><p>{LONG}</p><p><b>Bold words<br><p>Next &amp; last,\n  with   &lt;space&gt;.</p></article>"
TEXT = f"A title {LONG} Bold words Next & last, with <space>."


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def _page(before="", after=""):
    return f"<!DOCTYPE html><html><head><title>A title</title><script>var x='<p>no</p>';</script><style>p{{}}</style></head><body>{before}{ARTICLE}{after}</body></html>"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("", ""),
        ("<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>", "<footer>&copy; 2024 Someone, all rights reserved.</footer>"),
        ("<header><div class='logo'>The Site</div><form><label>Search</label><input><button>Go</button></form></header>", "<aside class='sidebar'><h3>Popular</h3><a href='/x'>One</a> <a href='/y'>Two</a></aside>"),
        ("<div class='ad'>Buy this now, it is cheap.</div><!-- ad -->", "<section id='comments'><h3>Comments</h3><div class='comment'><b>Jo</b><p>I liked this story a lot, thank you.</p></div></section>"),
        ("<div id='cookie-notice'>We use cookies. <button>Accept</button></div>", "<div class='newsletter-signup'><form>Your mail <input></form></div>"),
    ],
)
def test_the_article_is_left(model, before, after):
    assert html_text.main_texts([_page(before, after)], model) == [TEXT]


def test_pages_without_text(model):
    assert html_text.main_texts(["", None, "<html></html>", "<nav><a href='/'>Home</a></nav>"], model) == ["", "", "", ""]
    assert html_text.main_texts([], model) == []


def test_cut_off_pages(model):
    page = _page("<nav><a href='/'>Home</a></nav>")
    whole = page.index("Next &amp;")
    for end in range(whole, whole + 20):
        assert html_text.main_texts([page[:end]], model)[0].startswith(f"A title {LONG} Bold words")


def test_made_pages_that_were_not_learned_from(model):
    right = total = 0
    for seed in range(50_000, 50_080):
        page = marked_page(seed)
        nodes = parse(page)
        keep = [n.seen and (n.tag != "#" or MARK in n.text or not n.text.strip()) for n in nodes]
        want = html_text._render(nodes, keep).replace(MARK, "").split()
        got = html_text.main_texts([page.replace(MARK, "")], model)[0].split()
        right += sum((Counter(want) & Counter(got)).values())
        total += max(len(want), len(got))
    assert right / total > 0.95


def _best_by_trying(nodes, margin):
    """The largest sum of margins over all sets of nodes with the parent of each; blank texts count nothing."""
    value = [0.0 if n.tag == "#" and not n.text.strip() else float(m) for n, m in zip(nodes, margin, strict=True)]
    best = 0.0
    for chosen in itertools.product((False, True), repeat=len(nodes) - 1):
        keep = (True, *chosen)
        if all(keep[n.parent] or not k for n, k in zip(nodes[1:], chosen, strict=True)):
            best = max(best, sum(v for v, k in zip(value[1:], chosen, strict=True) if k))
    return best, value


def test_decoding_is_the_best_of_all_sets():
    r = random.Random(3)
    for _ in range(150):
        nodes = parse("".join(r.choice(("<div>", "<p>", "</div>", "<span>", "</span>", "x", " ", "<ul><li>", "</ul>")) for _ in range(r.randint(1, 9))))
        if len(nodes) > 11:
            continue
        margin = np.array([r.gauss(0, 1) for _ in nodes])
        best, value = _best_by_trying(nodes, margin)
        keep = html_text._decode(nodes, margin)
        assert abs(sum(v for v, k in zip(value[1:], keep[1:], strict=True) if k) - best) < 1e-9


def _rendered_by_recursion(nodes, i=0):
    """Text of a tree by plain recursion: blocks between blanks."""
    inner = nodes[i].text + "".join(_rendered_by_recursion(nodes, k) for k, n in enumerate(nodes) if n.parent == i and n.seen)
    return f" {inner} " if nodes[i].block else inner


@pytest.mark.parametrize("seed", range(0, 60, 5))
def test_rendering_is_that_of_a_recursive_one(seed):
    nodes = parse(marked_page(seed))
    assert html_text._render(nodes, [n.seen for n in nodes]) == " ".join(_rendered_by_recursion(nodes).split())


PARAGRAPHS = [f"{LONG} Here is part {w} of it." for w in ("one", "two", "three", "four")]
INNER = "<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul>"


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id='content'><div class='entry'>{}</div></div>", "<main><article>{}</article></main>", "<section class='story-body'>{}</section>"])
@pytest.mark.parametrize("around", [f"<nav>{MENU}</nav>{{}}<footer>&copy; 2024 Someone.</footer>", f"<div class='menu'>{MENU}</div>{{}}<div class='footer'>Imprint and contact</div>", "<header><span class='logo'>The Site</span></header>{}<div class='comments'><h3>Comments</h3><div class='comment'><b>Jo</b><p>I liked this a lot.</p></div></div>", f"{{}}<aside class='sidebar'><h3>Popular</h3>{MENU}</aside>"])
def test_templates(model, box, around):
    page = f"<html><head><title>A title</title></head><body>{around.format(box.format(INNER))}</body></html>"
    assert html_text.main_texts([page], model) == [" ".join(["A title", *PARAGRAPHS])]


def test_formulas_and_comments_lose_nothing(model):
    one, two, three = PARAGRAPHS[:3]
    page = f"<body><article><p>{one}</p><!--><p>{two} <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p><!---><p>{three}</p><!-- a --!><p>{one}</p></></article></body>"
    assert html_text.main_texts([page], model) == [f"{one} {two} E=m holds. {three} {one}"]


def test_a_head_that_is_not_closed_hides_nothing(model):
    assert html_text.main_texts([f"<head><title>x</title><article>{INNER}</article>"], model) == [" ".join(["A title", *PARAGRAPHS])]


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<div>" * 50_000 + "<p>" * 50_000, "<p><table><td>" + "<div>" * 50_000 + "</b>" * 50_000, '<a ">"' * 100_000 + "'", "<p " * 100_000, f"<div class='{'a' * 1_000_000}'>x"])
def test_time_grows_with_the_length(model, page):
    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 2
    html_text.main_texts([page], model)
    assert time.process_time() - began < 10


def test_no_node_is_kept_below_one_that_is_not(model):
    for seed in range(60_000, 60_020):
        nodes = parse(marked_page(seed).replace(MARK, ""))
        keep = html_text._decode(nodes, model.trees.margin(html_text.node_features([nodes], model)))
        assert all(keep[n.parent] or not k for n, k in zip(nodes[1:], keep[1:], strict=True))


def test_parsing():
    tags = lambda html: [(n.tag, n.text) for n in parse(html)[1:]]
    assert tags("a < b <p>c<p>d") == [("#", "a < b "), ("p", ""), ("#", "c"), ("p", ""), ("#", "d")]
    nodes = parse("<ul><li>a<li>b<ul><li>c</ul></ul><div>x")
    assert [nodes[n.parent].tag for n in nodes if n.tag == "li"] == ["ul", "ul", "ul"]
    assert [n.depth for n in nodes if n.tag in ("ul", "div")] == [1, 3, 1]
    assert tags("<script>a<b</script>x") == [("script", ""), ("#", "x")]
    assert tags("</p></div>x<br/>y") == [("#", "x"), ("br", ""), ("#", "y")]
    assert tags("<a title='>'>x</a><!-- <p> -->y") == [("a", ""), ("#", "x"), ("#", "y")]
    assert tags('x<a href="oops>y') == [("#", "x"), ("a", ""), ("#", "y")]
    assert name_tokens('class="siteHeader main-nav2" id=topBar style="display: none"') == ["site", "header", "main", "nav", "top", "bar", "hidden"]


def test_tables(spark, table, model):
    rows = [(1, "u", _page(), "x"), (1, "u", _page(), "x"), (None, None, None, None), (3, "u", "", "x"), (4, "u", "<p>" + f"{LONG} " * 3000, None)]
    rows = [(*r, "kept") for r in rows]
    df = html_text.with_main_text(table(rows, "page_id long, url string, html string, main_text string, __html_in string"), model)
    assert df.columns == ["page_id", "url", "html", "__html_in", "main_text"] and df.where("__html_in = 'kept'").count() == 5
    got = {r.page_id: r.main_text for r in df.collect()}
    assert got[1] == TEXT and got[3] == got[None] == "" and got[4] == " ".join([LONG] * 3000) and df.count() == 5
    assert html_text.with_main_text(table([], "page_id long, html string"), model).count() == 0
