"""Text of small pages, as a reader would expect it."""

import time

import pytest

from gridsignal.llm.htmltext import extract, visible_text

CASES = {
    "implied ends": ("<p>a<p>b <b>c</b>d<ul><li>x<li>y<ul><li>z</ul></ul>tail", "a\n\nb cd\n\n- x\n- y\n  - z\n\ntail"),
    "aligned cells": ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>all<td>x</table>after", "Name       Qty\napple pie  3\nall             x\n\nafter"),
    "row span": ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    "hidden": ("<div hidden>no</div><span style='visibility:hidden'>no<i style='visibility: visible'>yes</i></span> ok<p style='DISPLAY : none'>no", "yes ok"),
    "head": ("<!DOCTYPE html><html><head><title>t</title><meta charset=x><body>b", "b"),
    "no head tags": ("<title>t</title><style>p{}</style>b", "b"),
    "script": ("a<script>if(a<b)document.write('</p>')</script>b <!-- c --> d &amp; e < f", "ab d & e < f"),
    "textarea": ("<textarea>t&lt;x</textarea>", "t<x"),
    "pre": ("x<pre>a\n  b</pre>y", "x\n\na\n  b\n\ny"),
    "breaks": ("x<br>y<br><br>z", "x\ny\n\nz"),
    "ordered": ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    "reversed": ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    "definitions": ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    "quote": ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    "stray text in a table": ("<table>foo<tr><td>1<td>2</table>", "foo\n\n1  2"),
    "details": ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    "quoted bracket": ('<a title="x>y" href=\'z\'>k</a>', "k"),
    "unclosed quote": ('<p class="a>text</p>', "text"),
    "unclosed comment": ("a<!-- b", "a"),
    "spaces": (" a \n\t b&nbsp;&nbsp;c ", "a b  c"),
    "misnested": ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    "nested table": ("<table><tr><td>a<td><table><tr><td>1<td>2<tr><td>3<td>4</table><td>z</table>", "a  1  2  z\n   3  4"),
    "empty": ("", ""),
    "null": (None, ""),
    "only tags": ("<p></p><div><br></div>", ""),
    "quote after a value": ('<a href="x"">Link</a> some text <b class="y">bold</b>', "Link some text bold"),
    "lone quote": ('<p title="a" ">First paragraph.</p><p id="z">Second.', "First paragraph.\n\nSecond."),
    "quote in a bare value": ("<a href=it's>k</a> l <a title='m>n'>o</a>", "k l o"),
    "spaced equals": ('<p title = "a>b" hidden>no<p>yes', "yes"),
    "unclosed quote before others": ('<p class="a>text</p><p id="', 'text\n\n<p id="'),
    "empty comments": ("<!-->visible text<!---> more<!-- no --> end", "visible text more end"),
    "drawing": ("a<svg viewBox='0 0 1 1'><title>no</title><defs><text>no</text></defs><g>no<text x=1>Cats</text><text>Do<tspan>gs</tspan></text></g><defs/><text display=none>no</text><foreignObject><p>page</p></foreignObject></svg>b", "a\nCats\nDogs\n\npage\n\nb"),
    "unclosed drawing": ("<svg><path d='M0'/><p>text <svg/>after", "text after"),
    "hidden drawing": ("<span style='visibility:hidden'><svg><text>no</text><text visibility=visible>yes</text></svg></span>", "yes"),
    "unknown tag": ("<foo>a</foo>b</bar>", "ab"),
}


@pytest.mark.parametrize("name", CASES)
def test_visible_text(name):
    page, want = CASES[name]
    assert visible_text(page) == want


def test_depth_and_length_are_not_limited():
    assert visible_text("<div>" * 20000 + "x") == "x"
    assert visible_text("<ul><li>" * 3000 + "x").endswith("x")
    assert visible_text("<table><tr><td>" * 500 + "x").strip() == "x"
    assert len(visible_text("<p>word " * 50000).split()) == 50000


@pytest.mark.parametrize("part", ["<b></i>", "<svg><g><g>", "<div><td>", "<b><p></b>", "<li><b></ul>", "<table><i></b>"])
def test_many_open_elements_take_linear_time(part):
    """Tags that find no partner do not look through all that is open."""
    started = time.process_time()
    visible_text(part * (1_000_000 // len(part)) + "x")
    assert time.process_time() - started < 30


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", "<p>a", "t"), (None, "u", "<p>b", "t"), (2, "u", None, None), (1, "u", "<p>a", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0), r["text"]) for r in extract(df).collect())
    assert got == [(0, "b"), (1, "a"), (1, "a"), (2, "")]
    assert extract(df.limit(0)).collect() == []
