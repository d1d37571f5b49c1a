"""Whole articles in layouts that the labelled pages do not copy, and tags that end where HTML ends them."""

import numpy as np
import pytest

from strataloom.llm.html_text import block_features, default_field, leaf_blocks, main_text
from strataloom.llm.html_training import labelled_pages

TEXT = "This is a long paragraph of the article, with many words in it. It goes on for a while."
ARTICLES = {
    "pre and dl, no title": ("<article><p>One para here. And more.</p><pre>x=1</pre><dl><dt>Term</dt><dd>Its meaning, told in words.</dd></dl><p>Last para, in words too.</p></article>", ["One para here. And more.", "x=1", "Term", "Its meaning, told in words.", "Last para, in words too."]),
    "divs in an unknown container": (f"<div class=z1><h1>Title of it</h1><div>{TEXT} {TEXT}</div><div>{TEXT}</div></div>", ["Title of it", f"{TEXT} {TEXT}", TEXT]),
    "object": (f"<article><h1>T here</h1><p>{TEXT}</p><object><p>{TEXT} Two.</p></object></article>", ["T here", TEXT, f"{TEXT} Two."]),
    "unclosed svg": (f"<article><h1>T here</h1><p>{TEXT}</p><svg><text>draw</text><p>{TEXT} Two.</p></article>", ["T here", TEXT, f"{TEXT} Two."]),
    "slashes": (f"<article class=x/><h1>T here</h1><div class=y/><p>{TEXT}</p><p>{TEXT} Two.</p><p>{TEXT} Three.</p></div></article>", ["T here", TEXT, f"{TEXT} Two.", f"{TEXT} Three."]),
}
for _tag in ("article", "div class=post"):
    for _name in ("share", "newsletter", "ad", "related"):
        _html = f"<{_tag}><h1>Title words</h1><p>{TEXT}</p><div class={_name}>Short words here</div><p>{TEXT} Two.</p><p>{TEXT} Three.</p></{_tag.split()[0]}>"
        ARTICLES[f"{_name} inside {_tag}"] = (_html, ["Title words", TEXT, f"{TEXT} Two.", f"{TEXT} Three."])
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"


@pytest.mark.parametrize("name", ARTICLES)
def test_whole_articles(name):
    html, blocks = ARTICLES[name]
    assert main_text(f"<html><body>{html}</body></html>", default_field()) == "\n".join(blocks)
    assert main_text(f"<html><head><title>x</title></head><body>{MENU}{html}<footer><p>(c) us</p></footer></body></html>", default_field()) == "\n".join(blocks)


def test_tags_end_where_html_ends_them():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts("<p>a</p><svg><g><text>no</text></g></svg><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><svg class='i'/><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><svg><text>no</text><div>b</div>c") == ["a", "b", "c"]
    assert texts("<object data=x><p>shown</p></object><canvas>too</canvas>") == ["shown", "too"]
    assert texts("<p>a <math><mi>x</mi><mspace/><mo>=</mo></math> b</p><div class=q/>in</div>out") == ["a x= b", "in", "out"]
    inside = leaf_blocks("<div class=q/><p>in</p></div><p>out</p>")
    assert "name q" in inside[0].names and "name q" not in inside[1].names


def test_blocks_of_unseen_pages():
    """Most blocks of pages that were not trained on get their label; few of the article are lost."""
    field, found, kept, there = default_field(), 0, 0, 0
    for page in labelled_pages(100, seed=99):
        blocks = leaf_blocks(page)
        states, labels = field.decode(block_features(blocks)), np.array([int(b.label == "1") for b in blocks])
        found += int((states & labels).sum())
        kept += int(states.sum())
        there += int(labels.sum())
    assert found / there > 0.97 and found / kept > 0.95
