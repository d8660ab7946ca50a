import re

import pytest

from tidemark.llm import html_text as op

LONG = "This sentence is long enough to count as a block of running text in a page."

CASES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style>", ""),
    ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>One  two\n three<br>four<p>x</article><footer>f</footer>", "T & t\nOne two three\nfour\nx"),
    ("<article><p>short</p><aside>side</aside><div class='ad'>buy</div><p>end</p><form>f<input></form><section class='comments'><p>me too</p></section></article>", "short\nend"),
    ("<main><p>a<!-- no --> b&nbsp;c &lt;d&gt; &#233;</p></main>", "a b c <d> é"),
    (f"<div id=menu><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=content><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=footer>{LONG}</div>", f"{LONG}\nShort.\n{LONG}"),
    (f"<p>{LONG}</p><ul><li><a href=x>l1</a></li><li><a href=x>l2</a></li><li><a href=x>l3</a></li><li><a href=x>l4</a></li></ul>", LONG),
    ("<nav><p>never closed<article><p>kept</p></article>", "kept"),
    ("<article><p>cut off <b>here</b> <a hre", "cut off here"),
    ("<article><p title='a > b'>q</p><p>2 < 3 & 4</p></article>", "q\n2 < 3 & 4"),
    (f"<article><p title='{'a' * 6000} > LEAK'>x</p><p id=\"q\" data-x='{'> ' * 4000}'>y</p></article>", "x\ny"),
    ("<article><p>it's 5 > 4, \"so\"</p><p title=don't>z</p><p title = 'a>b'>w</p></article>", "it's 5 > 4, \"so\"\nz\nw"),
    ('<article><div class="social-studies"><p>a lesson</p></div><div class="entry-header"><h1>T</h1></div><div class="share-buttons">s</div><div class="related-posts-list">r</div></article>', "a lesson\nT"),
    ("<article><p>zero\u200bwidth\ufeff</p></article>", "zero\u200bwidth\ufeff"),
    ("<article><header><h1>Head</h1></header><p>body</p><footer>foot</footer></article>", "Head\nbody"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert op.main_text(page) == text


def test_table_of_pages(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(CASES)] + [(99, None, "<article>" + "<p>w x</p>" * 50_000 + "</article>"), (None, "u", CASES[4][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS Text", "8 AS other")
    got = {r.page_id: r for r in op.extract(df).collect()}
    assert op.extract(df).columns == ["page_id", "url", "other", "text", "n_chars"]
    for i, (_, text) in enumerate(CASES):
        assert got[i].text == text and got[i].n_chars == len(text)
    assert got[99].text == "\n".join(["w x"] * 50_000) and got[None].text == CASES[4][1]
    assert op.extract(df.limit(0)).count() == 0


def slow_text(page, window=op.WINDOW, threshold=op.THRESHOLD, near=op.NEAR):
    """Surge and dive by the definition: windows summed anew for each line, stretches found one by one."""
    found = op.lines(page or "")
    w = op.weights(found)
    n = len(found)
    block = [sum(w[i : i + window]) for i in range(n)]
    least = min(threshold, max(block, default=0) / 4) or 1
    kept, i = set(), 0
    while i < n:
        if w[i] and block[i] >= least:
            stop = next((j for j in range(i, n) if not block[j]), n)
            kept |= {j for j in range(i, stop) if w[j]}
            i = stop
        i += 1
    texts = [i for i in range(n) if found[i].text]
    for order in (texts, texts[::-1]):
        for a, b in zip(order, order[1:]):
            if a in kept and w[b] and abs(a - b) <= near + 1:
                kept.add(b)
    return "\n".join(found[i].text for i in sorted(kept))


def random_page(rnd):
    out = []
    for _ in range(rnd.randint(0, 40)):
        kind, n = rnd.random(), rnd.choice([1, 3, 12, 60])
        words = " ".join(rnd.choice(["lorem", "ipsum", "a", "dolor &amp; sit"]) for _ in range(n))
        out.append(f"<p>{words}</p>" if kind < 0.4 else f"<li><a href='{words}'>{words}</a></li>" if kind < 0.6 else "<div>" * rnd.randint(1, 9) if kind < 0.75 else f"<div class='{rnd.choice(['ad', 'x', 'menu'])}'>{words}</div>" if kind < 0.9 else rnd.choice(["<article>", "</article>", "<main>", "</main>", "</div>"]))
    return "".join(out)


def test_against_the_slow_version_and_windows_matter():
    import random

    rnd = random.Random(5)
    pages = [random_page(rnd) for _ in range(400)]
    changed = 0
    for page in pages:
        for window, threshold, near in ((3, 80, 6), (1, 30, 0), (8, 200, 2)):
            assert op.main_text(page, window, threshold, near) == slow_text(page, window, threshold, near)
        changed += op.main_text(page, 1, 80, 0) != op.main_text(page, 8, 80, 0)
    assert changed > 40
    gaps = f"<p>{LONG * 3}</p>{'<br>' * 5}<p>short one</p>{'<br>' * 5}<p>{LONG}</p>"
    assert op.main_text(gaps, 3, near=0) == f"{LONG * 3}\n{LONG}" and op.main_text(gaps, 12, near=0) == f"{LONG * 3}\nshort one\n{LONG}"


def test_the_same_text_without_article_elements(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    same = sum(op.main_text(p) == op.main_text(re.sub(r"<(/?)article>", r"<\1div>", p)) for p in pages)
    assert same == len(pages)
    assert all(op.main_text(p) == slow_text(p) for p in pages)


def test_test_pages_keep_their_articles(spark):
    """On the test tables the article element bounds the main text; whatever it holds must come out."""
    import html as h

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"</?\w[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h\d|br|ul|li|div)\b[^>]*>", inner[1])] if inner else []
        assert op.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_hostile_markup_is_read_in_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 20_000, "<p title='" * 20_000, "<div>" * 20_000, "<!--" * 20_000, "<script>" * 2000, "<p a='" * 20_001, '<p a="' * 20_001, "<p a=\"'" * 20_001, "<" * 200_000, "<b " * 20_000 + ">"):
        op.main_text(page)
    assert time.time() - began < 30


ROOMS = [
    f'<article class="post category-social"><h1>T</h1><p>{LONG}</p></article>',
    f'<div class="content no-sidebar"><h1>T</h1><p>{LONG}</p></div>',
    f'<div id="has-sidebar" class="tag-search"><h1>T</h1><p>{LONG}</p></div><div class="sidebar">x</div>',
    f'<article><header class="entry-header"><h1>T</h1></header><p>{LONG}</p><div class="post-comments">me</div></article>',
    f'<div class="widget"><h1>T</h1><p>{LONG}</p><div class="social">x</div></div>',
    f'<div class="search-result"><h1>T</h1><p>{LONG}</p></div><div class="search">x</div>',
    f"<div><h1>T</h1></div><div><p>{LONG}</p></div>",
    f'<nav><a href=x>a</a></nav><article><h1>T</h1><p>{LONG}</p></article><article class="ad">buy</article><div class="main-nav">x</div><div class="cookie-banner">y</div>',
]


@pytest.mark.parametrize("page", ROOMS)
def test_class_words_strip_no_main_text(page):
    assert op.main_text(page) == f"T\n{LONG}"


def test_class_words_still_strip_other_things():
    comments = f'<ol id="comments" class="comment-list">{f"<li><article class=comment-body><p>{LONG}</p></article></li>" * 9}</ol>'
    assert op.main_text(f"<article><p>short</p></article>{comments}") == "short"
    assert op.main_text(f'<div class="cookie-notice"><p>{LONG}</p></div>') == ""
    assert op.main_text(f'<div class="post-content">{LONG}</div><div class="post-share">{LONG}</div>') == LONG
    assert op.main_text(f"<div hidden><h1>T</h1>{LONG}</div>") == ""
