import time

import pytest

from tidemark.llm import html_text

LONG = "Running text of an article that goes on for a while, with more than enough words to count as a paragraph of its own. " * 3


def extracted(page: str) -> list[str]:
    blocks = html_text.blocks_of(page)
    path, _ = html_text.chosen(blocks, [])
    return html_text.joined(blocks, path).split("\n") if path else []


L = LONG.strip()
CASES = {
    "title and lead stand outside the winning container": (f'<article><h1>Title</h1><p>Lead</p><div class="content"><p>{L}</p></div></article>', ["Title", "Lead", L]),
    "two halves in sibling containers": (f"<div><a href=1>Home</a></div><div class=a><p>{L}</p><p>{L}</p></div><div class=b><p>{L}</p></div><div>Imprint</div>", [L, L, L]),
    "a title beside them": (f"<div class=wrap><h1>T</h1><div class=a><p>{L}</p></div><div class=b><p>{L}</p></div></div><div>Imprint</div>", ["T", L, L]),
    "names that hold words of boilerplate": (
        f'<article><p>{L}</p><div class="share-price-report"><p>{L}</p></div><div class="related-work"><p>{L}</p></div><div class="share-buttons">Share</div><section class="comments-area">Nice</section></article>',
        [L, L, L],
    ),
    "a page inside one form": (f'<form id="aspnetForm"><div><p>{L}</p><form class=search>Search</form></div></form>', [L]),
    "a small form inside a page": (f"<article><p>{L}</p><form><p>Your name</p></form></article>", [L]),
    "comments and menus around an article": (f"<nav>Menu</nav><main><article><p>{L}</p></article><div id=comments><p>{L}</p></div></main>", [L]),
    "a list of links beside the text": (f"<div class=a><p>{L}</p></div><div class=b>" + f"<p><a href=1>{L}</a></p>" * 2 + "</div>", [L]),
}


@pytest.mark.parametrize("name", CASES)
def test_shape(name):
    page, want = CASES[name]
    assert extracted(page) == want


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</i>" * 20000, "<b>" * 20000 + "<div></div>" * 20000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<p>" * 20000, "<form>" * 20000])
def test_unmatched_tags_are_linear(page):
    began = time.process_time()
    extracted(page)
    assert time.process_time() - began < 5


def test_a_very_long_good_page():
    page = "<article>" + f"<p>{L}</p>" * 20000 + "</article>"
    assert extracted(page) == [L] * 20000
