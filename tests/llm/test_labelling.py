"""Pages whose labels the cut decides, and the whole labelling against all labellings."""

import itertools

import pytest

from harrow.llm import html

LINE = "This is a sentence of the main text, long enough to be told from the rest."
LONG = " ".join([LINE] * 5)
MIXED = (
    f"<nav><a href=x>Home</a></nav><article><h1>Short</h1><p>{LINE}</p><p>No.</p><p>{LINE}</p></article><div class=promo><p>Buy it now.</p></div><footer>© 2020</footer>",
    f"<div class=widget><p>{LINE}</p><p>Yes</p></div><div class='related'><p>{LINE}</p></div><p>{LONG}</p>",
    f"<main><div class=promo><p>{LINE}</p><div class=search><p>{LONG}</p></div></div><p>x</p></main>",
)


@pytest.mark.parametrize("page", MIXED)
def test_labelling_is_the_least_of_all(page):
    terminal, edges = html.graph(html.blocks(page))
    assert len(terminal) <= 14

    def cost(side):
        return sum(abs(t) for t, s in zip(terminal, side, strict=True) if (t > 0) != s) + sum(w for i, j, w in edges if side[i] != side[j])

    side = html.min_cut(terminal, edges)
    assert cost(side) == min(map(cost, itertools.product((False, True), repeat=len(terminal))))
    assert html.main_blocks(page) == [b.text for b, s in zip(html.blocks(page), side, strict=False) if s]


def test_cut_decides_where_signs_are_wrong():
    # short lines of an article, against their own score
    page = f"<article><p>{LINE}</p><div>Note</div><p>{LINE}</p></article>"
    found = html.blocks(page)
    assert [html.score(b) > 0 for b in found] == [True, False, True]
    assert html.main_blocks(page) == [LINE, "Note", LINE]
    # a name against main text around many sentences is outweighed by them together, not by two
    for n, kept in ((2, 0), (8, 8)):
        assert len(html.main_blocks("<body><div class=widget>" + f"<p>{LINE}</p>" * n + "</div></body>")) == kept


def test_readers_long_comments_go():
    comments = "<ol class=comments>" + f"<li><p>{LONG}</p></li>" * 6 + "</ol>"
    assert html.main_text(f"<article><p>{LINE}</p></article>{comments}") == LINE
    assert html.main_text(f"<article><p>{LINE}</p>{comments}</article>") == LINE
