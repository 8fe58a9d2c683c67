"""Parts of an article that are not paragraphs, and the decoding against an enumeration of all labellings."""

import itertools
import random

import numpy as np
import pytest

from sedimenta.llm import html_extract

NAV = "<nav><a href=/>Home</a> <a href=/x>More</a></nav>"
FOOT = "<footer>&copy; Acme 2020 all rights</footer>"
BODY = "<p>The river rose on Monday, and the town was warned in good time by its watch.</p><p>It fell again on Friday, when the rain had ended at last.</p>"
TEXT = ["The river rose on Monday, and the town was warned in good time by its watch.", "It fell again on Friday, when the rain had ended at last."]
PAGES = {
    "header cells": (f"{NAV}<article><h1>Flood</h1>{BODY}<table><tr><th>Day</th><th>Level</th></tr><tr><td>Mon</td><td>2 m</td></tr></table></article>{FOOT}", ["Flood", *TEXT, "Day", "Level", "Mon", "2 m"]),
    "caption": (f"{NAV}<article><h1>Flood</h1>{BODY}<table><caption>Levels by day</caption><tr><th>Day</th><td>2 m</td></tr></table></article>{FOOT}", ["Flood", *TEXT, "Levels by day", "Day", "2 m"]),
    "details": (f"{NAV}<article><h1>Flood</h1>{BODY}<details><summary>How it was measured</summary><p>By a gauge at the old bridge, read every hour.</p></details></article>{FOOT}", ["Flood", *TEXT, "How it was measured", "By a gauge at the old bridge, read every hour."]),
    "figure": (f"{NAV}<article><h1>Flood</h1>{BODY}<figure><img src=a><figcaption>The bridge on Monday</figcaption></figure></article>{FOOT}", ["Flood", *TEXT, "The bridge on Monday"]),
    "definitions": (f"{NAV}<article><h1>Flood</h1>{BODY}<dl><dt>Gauge</dt><dd>A marked pole in the water.</dd></dl></article>{FOOT}", ["Flood", *TEXT, "Gauge", "A marked pole in the water."]),
    "own header, byline cut": (f"{NAV}<article><header><h1>Flood</h1><p class=byline>By A. Writer</p></header>{BODY}</article>{FOOT}", ["Flood", *TEXT]),
    "own header below the page's": (f"<header><div class=logo>Acme</div></header>{NAV}<main><article><header><h1>Flood in the town</h1></header>{BODY}</article></main>{FOOT}", ["Flood in the town", *TEXT]),
}


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_parts_of_an_article_stay(model, name):
    source, want = PAGES[name]
    assert html_extract.main_text([f"<html><body>{source}</body></html>"], model)[0].split("\n") == want


def test_decoding_is_the_best_of_all_labellings():
    """Outside above content above cut, where a node that holds content is outside or content."""
    r = random.Random(4)
    for _ in range(60):
        nodes = [html_extract.Node("body", None, "", 0)]
        for k in range(r.randint(1, 6)):
            nodes.append(html_extract.Node("div", r.choice(nodes), "", k + 1))
        for n in nodes:
            n.own = r.choice([0, 1, 5, 40])
        logit = np.array([r.gauss(0, 3) for _ in nodes])
        gain = [np.log1p(n.own) * np.clip(x, -6, 6) if n.own else 0.0 for n, x in zip(nodes, logit)]

        def allowed(states):
            return all(not n.parent or (states[n.parent.row], states[n.row]) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)} for n in nodes) and states[0] < 2

        best = max(sum(g for g, s in zip(gain, states) if s == 1) for states in itertools.product(range(3), repeat=len(nodes)) if allowed(states))
        content = html_extract.decode(nodes, logit)
        assert sum(g for n, g in zip(nodes, gain) if id(n) in content) == pytest.approx(best)
