"""Main text: frames around the content, broken pages, the best run against brute force."""

from __future__ import annotations

import random
import time

import pytest

from pacelens.llm import htmltext

PROSE = "<h1>Title here</h1><p>" + "some good words of the story " * 20 + "</p><p>" + "more words follow in the text " * 20 + "</p>"
WANTED = "\n".join(["Title here", " ".join(["some good words of the story"] * 20), " ".join(["more words follow in the text"] * 20)])
NAV = "<nav><a href=/>Home</a> <a href=/x>About us</a></nav>"
SIDE = '<div class="sidebar"><ul><li><a href=x>Other story</a></li></ul><p>Follow us today</p></div>'
FOOT = "<footer>Copyright 2020 somebody</footer>"

FRAMES = {
    "body": f'<html><body class="has-sidebar">{NAV}<div>{PROSE}</div>{SIDE}{FOOT}</body></html>',
    "layout": f'<body><div class="layout-with-sidebar">{NAV}<div class=post>{PROSE}</div>{SIDE}</div>{FOOT}</body>',
    "header": f'<body><div id="header-wrapper">{NAV}{PROSE}</div>{FOOT}</body>',
    "widget": f'<body>{NAV}<div class="widget-content">{PROSE}</div>{FOOT}</body>',
    "share": f'<body><div class="share-page"><article>{PROSE}</article>{SIDE}</div></body>',
    "related": f'<div class="related-content"><main>{PROSE}</main></div>',
    "form": f"<body><form id=aspnetForm>{NAV}<div>{PROSE}</div>{SIDE}{FOOT}</form></body>",
    "nested": f"<div class=layout-with-sidebar><div class=widget-content>{PROSE}</div>{SIDE}</div>",
    "plain": f"<body>{NAV}<div>{PROSE}</div>{SIDE}{FOOT}</body>",
}


@pytest.mark.parametrize("case", FRAMES)
def test_a_frame_never_blanks_a_page(case):
    assert htmltext.extract(FRAMES[case], htmltext.Weights({})) == WANTED


def test_an_aside_that_labelled_pages_show_stays_out():
    page = f'<body><div><p>{"a short story told here " * 10}</p></div><div class="comments">{PROSE}</div></body>'
    learned = htmltext.Weights({"div.comments": (0.0, 500.0)})
    assert htmltext.extract(page, learned) == " ".join(["a short story told here"] * 10)


@pytest.mark.parametrize("part", ["<div>word ", '<a "', '<a ">"', "<!x ", "</script ", "<p><a '\">"])
def test_broken_and_deep_pages_take_linear_time(part):
    def seconds(n):
        start = time.process_time()
        htmltext.extract(part * n, htmltext.Weights({}))
        htmltext.kind_counts("<article>x</article>" + part * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 20 * seconds(4_000) + 0.5


def test_unclosed_quotes_lose_no_text():
    page = '<p>before it</p><p title="never closed>inside of it</p><p>after it</p>'
    assert htmltext.extract(page, htmltext.Weights({})) == "before it\ninside of it\nafter it"


def test_best_run_is_the_first_of_the_greatest_sums():
    draw = random.Random(5)
    for _ in range(300):
        scores = [float(draw.randint(-4, 4)) for _ in range(draw.randint(0, 12))]
        runs = [(sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        greatest = max((r[0] for r in runs), default=0.0)
        start, end = htmltext.best_run(scores)
        assert sum(scores[start:end]) == max(greatest, 0.0)
        if greatest > 0:
            assert end == min(j for s, _, j in runs if s == greatest)
