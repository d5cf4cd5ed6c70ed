"""What stands in, around and beside an article."""

from __future__ import annotations

import pytest

from strata.llm import html_extract


def text(page):
    return "\n\n".join(t for r, t in html_extract.blocks_of(page) if r != "chrome")


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="page-content sidebar-left"><article><p>Text</p></article></div>', "Text"),
        ('<div class="related"><div><main>All of it</main></div></div>', "All of it"),
        ('<article><p>A long body of text</p></article><div class="related"><article>Teaser</article></div>', "A long body of text"),
        ('<main><article><p>A long body</p></article><div class="related"><article>A very much longer teaser</article></div></main>', "A long body"),
        ("<aside><article>Teaser</article></aside><article>Body</article>", "Body"),
        ('<article><p>Body</p><article class="comment"><p>Nice</p></article><section id="reader-comments"><p>So</p></section><div class="user-comment">Well</div></article>', "Body"),
        ('<article class="post has-comments menu"><p>Body</p></article>', "Body"),
        ("<article><p>Let <math><mi>x</mi></math> be.</p><p>Press <button>Go</button> now.</p></article>", "Let x be.\n\nPress Go now."),
        ("<article><p>Pick <select><option>a</option></select> now, <svg><text>no</text></svg>then.</p><button>Share</button></article>", "Pick now, then."),
        ('<article><p class="share">Kept</p><div class="legal">Law</div><h2 class="banner">Head</h2><div class="share-buttons">Share</div><div class="ad">Buy</div></article>', "Kept\n\nLaw\n\nHead"),
        ('<div class="legal">Law</div><p class="share">Share</p><p>Open</p>', "Open"),
        ('<article><p>One <span class="ad">buy</span> two</p></article>', "One\n\ntwo"),
    ],
)
def test_roles(page, want):
    assert text(page) == want
