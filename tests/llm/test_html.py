"""Main text of pages: marks that mislead, pages without an article element, omitted tags, long nests, and densities by brute force."""

import math
import random
import time

import pytest

from tidemill.llm import html_text

PROSE = "<h1>T</h1>" + "".join(f"<p>Paragraph number {i} of a plain article, which holds some words, a few commas, and an end.</p>" for i in range(8))
TEXT = "T " + " ".join(f"Paragraph number {i} of a plain article, which holds some words, a few commas, and an end." for i in range(8))
NAV = "<nav><a href=x>home</a> <a href=y>news</a></nav>"
COMMENTS = "<div class='comments'>" + "".join(f"<p>Reader {i} says this is good and bad in many words indeed, so it is.</p>" for i in range(30)) + "</div>"


@pytest.mark.parametrize("names", ['class="has-sidebar"', 'class="no-sidebar"', 'class="content-with-sidebar"', 'id="main-content" class="layout social-science"', 'class="notice-of-law"', 'class="comment-free"', 'class="side-effects"', 'class="shared hidden-gems"', 'class="sidebar"'])
def test_names_of_wrappers(names):
    for end in ("", '<div class="ad">Buy now.</div><div class="cookie-notice">We use cookies.</div>'):
        assert html_text.main_text(f"<html><body>{NAV}<div {names}>{PROSE}{end}</div><footer>foot of page</footer></body></html>") == TEXT


def test_form_around_the_page():
    assert html_text.main_text(f"<html><body><form id=page>{NAV}{PROSE}{COMMENTS}</form></body></html>") == TEXT
    assert html_text.main_text(f"<body>{NAV}<div class='no-sidebar'>{PROSE}{COMMENTS}</div><form>Search <input></form></body>") == TEXT


def test_comments_larger_than_the_article_go():
    assert html_text.main_text(f"<body>{NAV}<div>{PROSE}</div>{COMMENTS}<footer>f</footer></body>") == TEXT


def test_omitted_tags():
    assert html_text.main_text(f"<head><title>x</title><body>{NAV}{PROSE}") == TEXT
    assert html_text.main_text(f"<head><title>x</title><div>{PROSE}</div>") == TEXT
    assert html_text.main_text("<div><ul><li>one thing, and more<li>another thing, and more</ul><table><tr><td>a, b<td>c<tr><td>d</table></div>") == "one thing, and more another thing, and more a, b c d"


@pytest.mark.parametrize("icon", ['<svg class="icon"/>', "<svg />", '<svg><path d="M0 0"/><g><use href="#a"/></g></svg>', "<svg><title>icon</title><circle r=1></circle></svg>", "<math/>", '<p><svg class="icon" /></p>', "<span><svg><use/></svg></span>"])
def test_icons_do_not_swallow_what_follows(icon):
    for wrap in (f"<body>{NAV}<div>{icon}{PROSE}</div></body>", f"<body>{icon}{NAV}<div>{PROSE}</div></body>", f"<body><article>{icon}{PROSE}</article></body>", f"<body>{NAV}<div>{PROSE}{icon}<p>Last words of the article, after an icon, are kept.</p></div></body>"):
        assert html_text.main_text(wrap).startswith(TEXT)


@pytest.mark.parametrize("top, kept", [("<header class='entry-header'><h1>Own title</h1></header>", True), ("<div class='page-header'><h1>Own title</h1></div>", True), ("<div class='post-header'><h1>Own title</h1></div>", True), ("<div class='site-header'><h1>Name of the site</h1></div>", False)])
def test_own_headers_by_name(top, kept):
    body = PROSE.replace("<h1>T</h1>", "")
    want = ("Own title " if kept else "") + TEXT[2:]
    assert html_text.main_text(f"<body>{NAV}<div>{top}{body}</div><footer>f</footer></body>") == want
    inside = "Name of the site " if not kept else "Own title "
    assert html_text.main_text(f"<body>{NAV}<article>{top}{body}</article><footer>f</footer></body>") == inside + TEXT[2:]


def test_short_blocks_between_long_ones_stay():
    page = f"<body>{NAV}<div>{PROSE}<p>Yes.</p><p>{'A last long paragraph, with words. ' * 9}</p><p>End.</p></div></body>"
    assert "Yes. A last long" in html_text.main_text(page) and html_text.main_text(page).endswith("End.")


def test_deep_nests_take_linear_time():
    start = time.time()
    html_text.main_text("<div>" * 20_000 + "a b c" + "</span></i></section>" * 20_000)
    html_text.main_text("<i><div>" + "<b>" * 20_000 + "x" + "</i>" * 20_000)
    html_text.main_text("<div class=sidebar>" * 20_000 + "a b c")
    assert time.time() - start < 10


def test_the_chosen_node_has_the_largest_density_sum():
    """On random trees without article, against sums computed anew from each node's own subtree."""
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randrange(3, 25)
        kinds = ["body", *(rng.choice(["div", "div", "span", "a"]) for _ in range(n))]
        parent = [-1, *(rng.randrange(i) for i in range(1, n + 1))]
        pieces = [(i, "x" * rng.randrange(1, 200)) for i in range(n + 1) if rng.random() < 0.7]
        under = lambda i, j: j == i or j > 0 and under(i, parent[j])
        linked = lambda j: kinds[j] == "a" or j > 0 and linked(parent[j])
        size = lambda i, only=False: sum(len(s) for j, s in pieces if under(i, j) and (not only or linked_below(i, j)))
        linked_below = lambda i, j: kinds[j] == "a" or j != i and linked_below(i, parent[j])
        total, body = size(0), size(0, True) / max(size(0), 1)
        if not total:
            continue

        def dense(c, t, lc, lt, body=body):
            return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / math.log(c * lc / max(c - lc, 1) + body * c + math.e) if c else 0.0

        def of(i):
            links = sum(kinds[j] == "a" and under(i, j) for j in range(n + 1))
            return dense(size(i), sum(under(i, j) for j in range(n + 1)), size(i, True), links)

        sums = [sum(of(j) for j in range(1, n + 1) if parent[j] == i) + sum(dense(len(s), 1, len(s) * (kinds[i] == "a"), int(kinds[i] == "a")) for j, s in pieces if j == i) for i in range(n + 1)]
        chosen = html_text._choose(kinds, parent, pieces)
        if max(sums) > 0:
            assert any(chosen[i] for i in range(n + 1) if math.isclose(sums[i], max(sums)))
