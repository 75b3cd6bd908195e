import pytest

from harrow.llm import html

LONG = "This is a sentence of the main text, long enough to be told from the rest of it."
ARTICLE = f"<article><p>{LONG}</p></article>"

# elements without their end tags
OPEN = [
    f"<datalist><option value=a>A<option value=b>B</datalist>{ARTICLE}",
    f"<html><head><title>T</title><p>{LONG}",
    f"<html><head><title>T</title><meta a=b><noscript><link></head><body>{ARTICLE}<noscript>x</noscript>",
    f"<head><noscript><link><body>{ARTICLE}<noscript>x</noscript>",
    f"<label><select><option>a<option>b</label>{ARTICLE}",
    f"<article><p>{LONG[:40]}<svg><g><path/></g></svg>{LONG[40:]}</p></article>",
    f"<article><object><p>a<p>b<object>x</object>y</object><p>{LONG}</p></article>",
    *(f"<body><div><{e}>no text</div>{ARTICLE}" for e in sorted(html.MUTED)),
    *(f"<body><div><{e}>no text</div>{ARTICLE}<{e}>no</{e}>" for e in sorted(html.MUTED)),
    *(f"<body><{e}>no text{ARTICLE}" for e in sorted(html.MUTED)),
]


@pytest.mark.parametrize("page", OPEN)
def test_elements_without_end_tags_hide_no_more_than_their_text(page):
    assert html.main_text(page) == LONG


PROSE = " ".join([LONG] * 4)
# class and id names around main text
NAMED = [
    (f'<article class="post tag-search"><p>{LONG}</p></article>', LONG),
    (f'<article class="category-legal"><p>{LONG}</p></article>', LONG),
    (f'<body class="single no-sidebar"><p>{LONG}</p><p>{LONG}</p></body>', f"{LONG}\n{LONG}"),
    (f'<body class="login search-results"><p>{LONG}</p></body>', LONG),
    (f'<main id="print"><p>{LONG}</p></main>', LONG),
    (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG),
    (f'<div class="post tag-search"><p>{LONG}</p></div>', LONG),
    (f'<div class="category-legal"><p>{PROSE}</p><p>{PROSE}</p></div>', f"{PROSE}\n{PROSE}"),
    (f'<div class="widget"><div class="related"><p>{PROSE}</p></div></div>', PROSE),
    # still no main text
    (f'<article><p>{LONG}</p></article><div class="sidebar content"><p>{LONG}</p></div>', LONG),
    (f'<main><p>{LONG}</p><div class="comments"><article class="comment"><p>{LONG}</p></article></div></main>', LONG),
    (f'<article><p>{LONG}</p></article><footer class="post"><p>{PROSE}</p></footer><div class="main-nav"><p>{LONG}</p></div>', LONG),
    (f'<article><p>{LONG}</p></article><ul class="related">' + f"<li><a href=x>{PROSE}</a></li>" * 3 + "</ul>", LONG),
]


@pytest.mark.parametrize(("page", "text"), NAMED)
def test_one_name_does_not_empty_a_page(page, text):
    assert html.main_text(page) == text
