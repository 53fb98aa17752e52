"""Tables of pages: cells stand at the places a grid gives them, and the text grows with the page."""

from __future__ import annotations

import random

import pytest

from shelfscope.llm import html_text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><td rowspan=2>r<td>x<tr><td>a<tr><td>b</table>", "r  x\n   a\nb"),
        ("<table><tr><td rowspan=0>all<td>x<tr><td>a<tr><td>b</table>", "all  x\n     a\n     b"),
        ("<table><tr><td rowspan=2>r<td>x<tr></tr><tr><td>b</table>", "r  x\nb"),
        ("<table><tr><td rowspan=two>r<td colspan=0>x<tr><td>a<td>b</table>", "r  x\na  b"),
        ("<table><tr><td>a<td>" + "w" * 61 + "<td>c<tr><td>long<td>d<td>e</table>", "a     " + "w" * 61 + "  c\nlong  d  e"),
    ],
)
def test_spans_and_wide_cells(source, text):
    assert html_text.visible_text(source) == text


def grid_of(rows):
    """Row and column of every cell by marking the squares of a grid one by one."""
    full, places = set(), {}
    for r, row in enumerate(rows):
        for word, across, down in row:
            c = next(c for c in range(1000) if (r, c) not in full)
            places[word] = (r, c)
            full |= {(r + i, c + j) for i in range(down) for j in range(across)}
    return places


def test_cells_against_a_grid():
    rng = random.Random(5)
    for _ in range(200):
        number = iter(range(10_000))
        rows = [
            [(f"w{next(number)}" + "x" * rng.randint(0, 9), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 5))]
            for _ in range(rng.randint(1, 6))
        ]
        source = "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{w}</td>" for w, a, d in row) for row in rows)
        lines = html_text.visible_text(f"<table>{source}</table>").split("\n")
        places = grid_of(rows)
        widths = {}
        for row in rows:
            for word, across, _ in row:
                if across == 1:
                    c = places[word][1]
                    widths[c] = max(widths.get(c, 0), len(word))
        assert len(lines) == len(rows)
        for row in rows:
            for word, *_ in row:
                r, c = places[word]
                at = lines[r].index(word)
                begin = sum(widths.get(x, 0) + 2 for x in range(c))
                # A cell over several columns may be wider than they are, and pushes its neighbours.
                assert at == begin or (at > begin and lines[r][at - 2 : at] == "  " and lines[r][at - 3] != " ")


def test_text_grows_with_the_page():
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>x" + "<tr><td>a<td>b" * 20_000 + "</table>"
    tall = "<table><tr><td>" + "w" * 60 + "<td>" * 500 + "x<br>" * 5_000 + "</table>"
    spread = "<table><tr>" + ("<td>" + "w" * 60) * 100 + "<tr><td colspan=99>a<td>b" * 2_000 + "</table>"
    for source, most in ((wide, 4), (tall, 60), (spread, 60)):
        text = html_text.visible_text(source)
        assert len(text) <= most * len(source)
        assert text.count("w") == source.count("w") and text.count("x") == source.count("x")
