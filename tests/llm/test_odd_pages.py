import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriptlab.llm import ann, vectors
from transcriptlab.llm.html import main_text

LONG = " ".join(["and this is what the writer of the page had to say about it to all who were there with them in the end."] * 4)
MORE = " ".join(["but then it was not clear to them if that would be so, or what the others had said to her about it."] * 3)

#: Pages labelled by hand: html, and the text that a reader would copy.
PAGES = {
    "share link in a paragraph": (f'<article><p>Start <a class="share">s</a> {LONG}</p></article>', f"Start {LONG}"),
    "frame in a paragraph": (f"<article><p>Start <iframe>s</iframe> {LONG}</p></article>", f"Start {LONG}"),
    "hidden span": (f"<article><p>Start <span hidden>s</span> {LONG}</p></article>", f"Start {LONG}"),
    "advert span": (f'<article><p>Start <span class="ad">s</span> {LONG}</p></article>', f"Start {LONG}"),
    "footnote mark": (f'<article><p>Start<sup class="footnote-widget">1</sup> {LONG}</p></article>', f"Start {LONG}"),
    "button": (f"<article><p>Start <button>Buy</button> {LONG}</p></article>", f"Start {LONG}"),
    "object": (f"<article><p>Start <object>x</object> {LONG}</p></article>", f"Start {LONG}"),
    "select": (f"<div><p>Start <select><option>a<option>b</select> {LONG}</p></div>", f"Start {LONG}"),
    "two in a row": (f'<article><p>Start <button>a</button><span class="ad">b</span> {LONG} <a class="share">c</a> end.</p></article>', f"Start {LONG} end."),
    "one within another": (f'<article><p>Start <span class="share">a <button>b</button> c</span> {LONG}</p></article>', f"Start {LONG}"),
    "inside a word": (f'<article><p>{LONG} un<span class="ad">x</span>broken</p></article>', f"{LONG} unbroken"),
    "never closed": (f'<article><p>Start <span class="ad">s</p><p>{LONG}</p></article>', f"Start\n{LONG}"),
    "within bold": (f'<article><p><b>Start <button>x</button> bold</b> {LONG}</p></article>', f"Start bold {LONG}"),
    "two short paragraphs": ("<p>One.</p><p>Two.</p>", "One.\nTwo."),
    "plain text": ("Hello world.", "Hello world."),
    "recipe": ("<h1>Soup</h1><ul><li>Water</li><li>Salt</li></ul><p>Cook it.</p>", "Soup\nWater\nSalt\nCook it."),
    "short page with a menu": ("<nav><a>Home</a></nav><p>Closed today.</p><footer>Us</footer>", "Closed today."),
    "short page with a link list": ("<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><p>Closed today.</p>", "Closed today."),
    "last items": (f"<div><p>{LONG}</p><ul><li>One item</li><li>Two</li></ul></div>", f"{LONG}\nOne item\nTwo"),
    "last cells": (f"<div><p>{LONG}</p><table><tr><td>a</td><td>b</td></tr></table></div>", f"{LONG}\na\nb"),
    "caption": (f"<div><p>{LONG}</p><figure><img><figcaption>A view</figcaption></figure></div>", f"{LONG}\nA view"),
    "last links": (f"<div><p>{LONG}</p><ul><li><a>More news</a></li><li><a>Even more</a></li></ul></div>", LONG),
    "article on cookies": (f'<article><section id="cookies"><p>{LONG}</p></section></article>', LONG),
    "law of copyright": (f'<article><h1>Law</h1><div class="copyright-law"><p>{LONG}</p></div><p>{MORE}</p></article>', f"Law\n{LONG}\n{MORE}"),
    "ad hoc": (f'<div class="ad-hoc"><p>{LONG}</p></div>', LONG),
    "advert in an article": (f'<article><p>{LONG}</p><div class="ad"><p>{MORE}</p></div></article>', LONG),
    "advert slot": (f'<article><p>{LONG}</p><div class="ad-slot-3"><p>{MORE}</p></div></article>', LONG),
    "notice in an article": (f'<article><p>{LONG}</p><div class="cookie-notice">We use cookies.</div></article>', LONG),
    "site footer": (f'<div><p>{LONG}</p></div><div class="site-footer"><p>All rights are ours, and so is the rest.</p></div>', LONG),
    "comments": (f'<article><p>{LONG}</p></article><div id="comments"><p>{MORE}</p></div>', LONG),
    "comments in an article": (f'<article><p>{LONG}</p><section class="comments"><p>{MORE}</p></section></article>', LONG),
    "empty": ("", ""),
    "only a menu": ("<nav><ul><li>a</li></ul></nav>", ""),
    "only a script": ("<script>var a = '<p>x</p>';</script>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_labelled_by_hand(name):
    page, text = PAGES[name]
    assert main_text(page) == text


@pytest.mark.parametrize("offset", [0.0, 1e3, 1e6])
def test_neighbours_far_from_the_origin(spark, offset):
    """Factor 1 is exact however large the vectors are beside their distances."""
    rng = np.random.default_rng(1)
    x = offset + rng.integers(0, 30, (60, 6))[rng.integers(0, 60, 1500)] + 0.001 * rng.normal(size=(1500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = vectors.vectors(df, zero=False)
    got = {}
    for r in ann.neighbours(rows.filter(F.col("vec_id") % 50 == 0), rows, 5, factor=1.0, block_rows=8, shard_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((float(d[i]), i) for i in range(1500) if i != q)[:5]
        assert [(i, s) for s, i in want] == [(i, pytest.approx(s, rel=1e-9)) for i, s in got[q]]


def test_pivots_come_from_a_bounded_draw(spark, monkeypatch):
    """No window sorts a table, and equal vectors are drawn one by one."""
    monkeypatch.setattr(vectors, "SAMPLE", 200)
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)), F.rand(2)).alias("embedding"))
    rows = vectors.vectors(df, zero=False)
    drawn = []
    real = np.array
    monkeypatch.setattr(vectors.np, "array", lambda x, *a: drawn.append(len(x)) or real(x, *a))
    pivots = vectors.choose_pivots(rows, 1000)
    assert pivots[2].shape == (20, 2) and 100 < drawn[0] < 320
    again = vectors.choose_pivots(rows.repartition(7), 1000)
    assert (again[2] == pivots[2]).all()
