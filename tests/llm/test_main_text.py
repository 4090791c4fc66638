"""Line blocks decide on pages with and without a marked article."""

import pytest

from loomgraph.llm import main_text

LONG = "Some real text that goes on for a while. " * 10
MENU = "<ul>" + "<li><a href=x>Go there</a></li>" * 4 + "</ul>"


@pytest.mark.parametrize(("page", "want"), [
    # a card that is marked as an article beside the text
    (f'<article class="card"><p>Teaser of it</p></article><div>{MENU}</div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', [LONG] * 3),
    # a list of links within an article, of a class that says nothing
    (f'<article><p>{LONG}</p><div class="xyz">{MENU}</div></article>', [LONG]),
    # text outside the marked article
    (f"<article><p>{LONG}</p></article><div><p>All rights reserved to us.</p></div>", [LONG]),
])
def test_article_mark_is_weight(page, want):
    assert main_text.main_text(page) == " ".join(x.strip() for x in want)


@pytest.mark.parametrize(("page", "want"), [
    (f"<body><div><p>{LONG}</p></div><div><p>The end.</p></div>", [LONG, "The end."]),
    # light stretches: between two others, and in the container of one
    (f"<div><p>{LONG}</p></div>{MENU}<div><p>Short.</p></div>{MENU}<div><p>{LONG}</p></div>", [LONG, "Short.", LONG]),
    (f"<div><div><p>{LONG}</p></div>{MENU}<div><p>The end.</p></div></div>", [LONG, "The end."]),
    (f"<div><div><p>{LONG}</p></div></div><div>{MENU}</div><div><p>We of this site</p></div>", [LONG]),
    ("<div><p>One line.</p></div>" * 3, ["One line."] * 3),
    (f"<div><p>One line.</p></div>{MENU}<div><p>Two lines.</p></div>", ["One line.", "Two lines."]),
    (f"<p>{LONG}</p><p>See <a href=x>a long name of a page</a>.</p><p>{LONG}</p>", [LONG, "See a long name of a page.", LONG]),
])
def test_pages_without_an_article(page, want):
    assert main_text.main_text(page) == " ".join(x.strip() for x in want)


P = LONG.strip()


@pytest.mark.parametrize(("page", "want"), [
    # end tags that HTML lets out
    (f"<html><head><title>t</title><meta charset=x><p>{LONG}<p>{LONG}", [P, P]),
    (f"<head><title>t</title>{LONG}", [P]),
    (f"<article><p class=notice>Notice here<p>{LONG}<p>{LONG}</article>", [P, P]),
    (f"<article><ul><li class=ad>Buy<li>Item one of it.<li>Item two.</ul><p>{LONG}</article>", ["Item one of it.", "Item two.", P]),
    (f"<article><dl><dt>Term<dd class=ad>Buy<dt>Word<dd>What it means.</dl><p>{LONG}</article>", ["Term", "Word", "What it means.", P]),
    (f"<article><table><tr><td>one<td>two<tr><td class=ad>advert<td>three</table><p>{LONG}</article>", ["one", "two", "three", P]),
    (f"<article><p>{LONG}</p><li class=share>Share<p>Para one. {LONG}</p><p>{LONG}</p></article>", [P, f"Para one. {P}", P]),
    (f"<nav><ul><li>x<li>y<article><p>{LONG}</article>", [P]),
    # end tags that belong to nothing
    (f"<article><p>{LONG}</p></div></section></span><p>{LONG}</p></article>", [P, P]),
    # a form around the page
    (f"<body><form id=f><div class=header>Site</div><div class=main><p>{LONG}</p><p>{LONG}</p></div><div class=footer>Imprint</div></form>", [P, P]),
    (f"<body><form><nav>menu</nav><article><p>{LONG}</p><form>Name <input></form></article></form>", [P]),
    (f"<div class=sidebar-layout><div class=widget><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>Other things to see</div></div>", [P, P]),
    # what only looks like boilerplate within an article
    (f"<article><p>{LONG}</p><div class='related-work'><p>Related work is here.</p></div><section id=search><p>A part on search.</p></section><p>{LONG}</p></article>", [P, "Related work is here.", "A part on search.", P]),
    # and what is
    (f"<article><p>{LONG}</p><div class='share-buttons'>Share on X</div><div class='ad'>Buy</div><p>{LONG}</p></article>", [P, P]),
    (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></article>", [P]),
    (f"<article><p>{LONG}</p></article><div class=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", [P]),
    (f"<article><p>{LONG}</p><aside><p>{LONG}</p><p>{LONG}</p></aside></article>", [P]),
    (f"<article><p>{LONG}</p></article><aside><article class=card><p>Teaser card</p></article></aside>", [P]),
    ("<div class=ad>An advert that is longer than all of the article.</div><article><h1>The.</h1><p>The.</p></article>", ["The.", "The."]),
    (f"<div class=ad>{LONG}</div><p>Short article.</p>", ["Short article."]),
    # links
    (f"<article><p>{LONG}</p>" + "".join(f"<p><a href=x>Linked paragraph {i}</a></p>" for i in range(4)) + f"<p>{LONG}</p></article>", [P, *(f"Linked paragraph {i}" for i in range(4)), P]),
    (f"<article><p><a name=x>First. {LONG}<p>Second. {LONG}<p>Third. {LONG}</article>", [f"First. {P}", f"Second. {P}", f"Third. {P}"]),
    (f"<div><p><a name=x>First. {LONG}<p>Second. {LONG}<p>Third. {LONG}</div>", [f"First. {P}", f"Second. {P}", f"Third. {P}"]),
    # a line before the text that is a link stays out where no article is marked; the link ends with its paragraph
    (f"<div><p><a href=x>First.</p><p>Second. {LONG}</p><p>Third. {LONG}</p></div>", [f"Second. {P}", f"Third. {P}"]),
    # pieces of a line
    (f"<p>{LONG}</p><p>foo<span class=ad>x</span>bar and so on</p><p>{LONG}</p>", [P, "foobar and so on", P]),
    (f"<p>{LONG}</p><p>a &amp; b&nbsp;c\n d</p><p>{LONG}", [P, "a & b c d", P]),
    # cut off
    (f"<article><p>{LONG}</p><p>{LONG}<b", [P, P]),
    (f"<article><p>{LONG}</p><!-- {LONG}", [P]),
    (None, []),
    ("", []),
    ("<nav>only a menu</nav>", []),
])
def test_shapes_of_pages(page, want):
    assert main_text.main_text(page) == " ".join(x.strip() for x in want)


def test_very_long_and_deep_pages():
    page = "<div>" * 20_000 + f"<p>{LONG}</p>" * 3_000 + "</div>" * 100 + "<p>The end.</p>"
    assert main_text.main_text(page) == " ".join([P] * 3_000 + ["The end."])


def test_rows_repeat_and_other_columns_stay_out(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x")] * 2 + [(None, None, None, "y")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", P, len(P))] * 2 + [(None, None, "", 0)], key=str)
