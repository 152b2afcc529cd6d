"""Main text against generated pages whose article is known, and with the ratios switched off."""

import random
import time

import numpy as np
import pytest

from cohesia.llm import html_text

WORDS = "river stone light under across morning carried quiet winter letters harbour engine market seven gardens bridge written corner silver answer".split()


def sentence(r, low, high):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + "."


def links(r, n):
    return "".join(f"<li><a href='/{k}'>{r.choice(WORDS)} {r.choice(WORDS)}</a></li>" for k in range(n))


def page(r, named):
    """A page and its article; without names, nothing but the ratios tells menus from text."""
    blocks = [sentence(r, 4, 8)] + [sentence(r, 12, 60) for _ in range(r.randint(4, 12))]
    blocks.insert(r.randint(2, len(blocks) - 1), "Short &amp; plain.")
    paragraphs = "".join(f"<p>{b}" + r.choice(("</p>", "</p>\n", "")) for b in blocks[1:])
    head = f"<h1>{blocks[0]}</h1>"
    menu, more = links(r, r.randint(6, 14)), links(r, r.randint(6, 14))
    if named:
        comments = "<div id='comments'><p>" + sentence(r, 20, 40) + "</p><article class='comment'>" + sentence(r, 20, 30) + "</article></div>"
        body = (
            f"<header><p>{sentence(r, 9, 30)}</p></header><nav><ul>{menu}</ul></nav><div class='cookie-notice'>{sentence(r, 20, 30)}</div><article>"
            f"<header>{head}</header>{paragraphs}<div class='ad'>{sentence(r, 8, 30)}</div></article>{comments}<aside>{sentence(r, 10, 30)}</aside><footer>{sentence(r, 5, 20)}</footer>"
        )
    else:
        inner = f"{head}<div>{paragraphs}</div>" if r.random() < 0.5 else head + paragraphs
        shell = r.choice(("<div class='x1'>{}</div>", "<table><tr><td>{}</td></tr></table>", "<div><div><section>{}</section></div></div>"))
        body = f"<div class='x0'><ul>{menu}</ul></div>{shell.format(inner)}<div class='x2'><ul>{more}</ul></div>"
    text = "\n\n".join(b.replace("&amp;", "&") for b in blocks)
    return f"<!DOCTYPE html><html><head><title>No</title><script>var t='</p>';</script></head><body>{body}</body></html>", text


@pytest.mark.parametrize("named", [True, False])
def test_generated_pages(named):
    r = random.Random(3)
    pages = [page(r, named) for _ in range(200)]
    right = sum(html_text.main_text(h) == t for h, t in pages)
    assert right >= (200 if named else 194), right


def test_the_ratios_decide(monkeypatch):
    r = random.Random(4)
    pages = [page(r, False) for _ in range(60)]
    for wrong in (lambda lines: np.ones(len(lines)), lambda lines: np.random.default_rng(len(lines)).random(len(lines))):
        with monkeypatch.context() as m:
            m.setattr(html_text, "ratios", wrong)
            assert sum(html_text.main_text(h) == t for h, t in pages) <= 20


def test_deep_and_long_pages_take_time_in_proportion():
    def took(html):
        began = time.perf_counter()
        html_text.main_text(html)
        return time.perf_counter() - began

    deep = "<div>" * 100_000 + "<p>the only text of this page stands here</p>" + "</section></span></div>" * 100_000
    assert html_text.main_text(deep) == "the only text of this page stands here"
    assert took(deep) < 20
    assert html_text.main_text("<p>some words of the text</p>" * 50_000).count("\n\n") == 49_999


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>open <b>bold", 3), (3, "u", "<p>open <b>bold", 3), (None, None, "plain & simple", None), (4, "u", "<nav>x</nav>", 4), (5, "u", "<br>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `text` int")
    got = sorted(((x["page_id"] or 0, x["text"], x["n_chars"]) for x in html_text.extract(df).collect()))
    assert got == [(0, "plain & simple", 14), (1, "", 0), (2, "", 0), (3, "open bold", 9), (3, "open bold", 9), (4, "", 0), (5, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
