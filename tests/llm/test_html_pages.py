"""The main text of pages: built pages whose text is known, a plain twin of the surge and dive rule, odd tables."""

import random
from collections import Counter

import pytest

from barsmith.llm import html_text

SMALL = "/root/testdata/sf0.001"
LONG = ("long text " * 12).strip()


def built_page(rng, tag):
    """A page with furniture around it and adverts, notices and headings inside; and its text."""
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "&amp;", "gamma,", "d&eacute;j&agrave;", "x"]) for _ in range(n))
    blocks, body = [], []
    for i in range(rng.randrange(1, 9)):
        t = words(rng.choice([1, 2, 5, 40, 200]))
        if i == 1:
            t = words(60)
        name = rng.choice(["p", "h2", "li", "blockquote", "div"])
        body.append(f"<{name}>{t}</{name}>")
        blocks.append(t.replace("&amp;", "&").replace("&eacute;", "é").replace("&agrave;", "à"))
        if rng.random() < 0.4:
            body.append(rng.choice(["<div class='ad'>Buy this thing today</div>", "<aside>By the way</aside>", "<form><input name=q>Find</form>", "<script>var a = '<p>no</p>';</script>",
                                    "<div class='cookie-notice'><p>We use them</p></div>"]))
    head = "<html><head><title>T</title></head><body><nav><ul><li>Home<li>News</ul></nav><header><h1>Site</h1></header><div class=sidebar>" + words(30) + "</div>"
    tail = "<div class=comments><article class=comment><p>" + words(50) + "</p></article></div><footer>f</footer>"
    if len(blocks) == 1:
        body[0] = f"<p>{LONG}</p>"
        blocks = [LONG]
    return f"{head}<{tag}>{''.join(body)}</{tag}>{tail}", "\n".join(blocks)


@pytest.mark.parametrize("tag", ["article", "main", "div", "section", "div class=post"])
def test_built_pages(tag):
    rng = random.Random(tag)
    for _ in range(300):
        page, want = built_page(rng, tag)
        assert html_text.main_text(page) == want


@pytest.mark.parametrize(("page", "want"), [
    (f"<p>Opening.</p><div class=ad>Buy</div><p>{LONG}</p><div class=advert>x</div><p>Closing.</p>", f"Opening.\n{LONG}\nClosing."),
    (f"<article><header><h1>Title</h1><p>by me</p><nav><h2>x</h2></nav></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    (f"<div><div class=post-header><h1>Title</h1><span>by me</span></div><p>{LONG}</p></div>", f"Title\n{LONG}"),
    (f"<header><h1>Site</h1></header><p>{LONG}</p>", LONG),
    (f"<p>Home</p><nav>x</nav><p>{LONG}</p><footer>f</footer><p>tail</p>", LONG),
    (f"<article><p>a</p></article><aside>b</aside><article><p>{LONG}</p></article>", f"a\n{LONG}"),
])
def test_openings_closings_and_headlines(page, want):
    assert html_text.main_text(page) == want


def plain_region(sizes):
    """Lines between the first surge and the last dive of line lengths, window by window."""
    windows = [sum(sizes[i:i + html_text.WINDOW]) for i in range(len(sizes))]
    least = min(html_text.SURGE, max(windows) / 2)
    kept = set()
    for i, w in enumerate(windows):
        if w >= least:
            a = i
            while a and sum(sizes[a - 1:a - 1 + html_text.WINDOW]):
                a -= 1
            b = i
            while b < len(sizes) and sum(sizes[b:b + html_text.WINDOW]):
                b += 1
            kept |= set(range(a, b))
    return [i for i in range(min(kept), max(kept) + 1) if sizes[i]]


def test_region_equals_plain_surge_and_dive():
    rng = random.Random(4)
    for _ in range(500):
        parts = [rng.choice([0, 0, 3, 20, 70, 300]) for _ in range(rng.randrange(1, 15))]
        if not any(parts):
            continue
        page, texts, sizes = "", [], []
        for i, n in enumerate(parts):  # a menu parts the page there and ends the region
            t = f"{i:02d}" + "x" * (n - 2) if n else ""
            page += f"<p>{t}</p>" if n else "<nav>n</nav>"
            texts += [t] if n else [""] * html_text.WINDOW
            sizes += [len(t)] if n else [0] * html_text.WINDOW
        assert html_text.main_text(page) == "\n".join(texts[i] for i in plain_region(sizes))


def test_articles_without_their_marks(spark):
    """The same text where the pages of the table name no article."""
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        bare = (r.html or "").replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(bare) == html_text.main_text(r.html or "")


def test_odd_tables(spark, odd, nothing):
    """Nulls, repeated rows, plain text, a very long page, clashing columns; an empty table."""
    got = html_text.html_text(odd, "doc_id", "n_words", "text")
    assert got.columns == ["doc_id", "n_words", "text", "n_chars"]
    want = Counter((r.doc_id, " ".join((r.text or "").split())) for r in odd.collect())
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert all(r.n_chars == len(r.text) for r in got.collect())
    page = "<article>" + f"<p>{LONG}</p><div class=ad>Buy</div>" * 20_000 + "</article>"
    assert html_text.main_text(page) == "\n".join([LONG] * 20_000)
    assert html_text.html_text(nothing, "doc_id", "lang", "text").collect() == []
