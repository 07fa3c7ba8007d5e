import random
import time

import pytest

from tidemark.llm import html_text as h

W = h.default_weights()


def test_best_region_against_all_regions():
    chance = random.Random(1)
    for _ in range(300):
        scores = [chance.choice([-3, -1, -0.2, 0, 1, 2.5]) for _ in range(chance.randrange(12))]
        a, b = h.best_region(scores)
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)] + [0])
        assert abs(sum(scores[a:b]) - best) < 1e-9


def test_article_without_what_stands_around():
    page = """<!DOCTYPE html><html><head><title>T one</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
    <header>Site name and more words</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies on this site</div>
    <article><h1>Big &amp; small</h1><p>First <b>bold</b>er\n  line<br>next.</p><div class="ad">Buy this now</div><p>Second&nbsp;one</p><form>Name <input></form><p>Last</p></article>
    <aside>Other things to read</aside><section id="comments"><p>I think that this is a long comment by a reader</p></section><footer>&copy; 2024 all rights</footer></body></html>"""
    assert h.extract(page, W) == "Big & small First bolder line next. Second one Last"


def test_broken_pages():
    assert h.extract(None, W) == h.extract("", W) == h.extract("<nav>menu only</nav>", W) == h.extract("<script>never closed", W) == ""
    assert h.extract("just words", W) == "just words"
    assert h.extract("<p>one<p>two <!-- open", W) == "one two"
    assert h.extract('<p title="a>b">x &lt;b&gt;</p><footer>f', W) == "x <b>"


def test_frame(spark):
    rows = [(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "x"), (2, None, None, None), (None, "v", "<p>é</p>", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, h.main_text(frame).collect()), key=str)
    assert got == [(1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "", 0), (None, "v", "é", 1)]
    assert h.main_text(frame.limit(0)).count() == 0


STORY = "<p>" + "The story goes on here with more words and a point. " * 6 + "</p><p>Yes.</p><p>It then ended, said the man.</p>"
TOLD = " ".join(("The story goes on here with more words and a point. " * 6 + "Yes. It then ended, said the man.").split())


@pytest.mark.parametrize("opened, closed", [
    ('<article class="post share-target">', "</article>"), ('<div id="legal-article">', "</div>"), ('<div class="section header-wrap">', "</div>"), ('<main class="form-guide">', "</main>"),
    ("<div>Home News Sport Contact</div><div>", "</div><div>All rights reserved</div>"), ('<div class="layout has-sidebar"><div>', '</div><div class="sidebar"><p>Read this other thing, too.</p></div></div>'),
])
def test_names_are_evidence_only(opened, closed):
    assert h.extract(f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{opened}{STORY}{closed}<footer>(c) x</footer></body></html>", W) == TOLD


def held_out():
    out = []
    for parts in h.labelled_pages(150, 99):  # pages that weights weren't learned from
        page, flags = h._labels(parts)
        out.append((page, flags, h.features(page, h.Extractor(W).known)))
    return out


def kept(extractor, pages):
    return [extractor.keep(page, [(t, n, extractor.likelihood(place)) for t, n, place in places]) for page, _, places in pages]


def right(keeps, pages):
    """Share of words, and of pages, that come out right."""
    words = [[(n, keep[t] == flags[t]) for t, n, _ in places] for keep, (_, flags, places) in zip(keeps, pages, strict=True)]
    return sum(n for page in words for n, good in page if good) / sum(n for page in words for n, _ in page), sum(all(good for _, good in page) for page in words) / len(pages)


def test_region_and_weights_both_decide(monkeypatch):
    pages = held_out()
    learned = kept(h.Extractor(W), pages)
    assert right(learned, pages)[0] >= 0.98 and right(learned, pages)[1] >= 0.85
    plain = kept(h.Extractor(h.Weights(dict.fromkeys(W.features, 0.0) | {"page": 1.0}, W.threshold, W.tag)), pages)
    assert right(plain, pages)[0] < right(learned, pages)[0] - 0.2
    monkeypatch.setattr(h, "best_region", lambda scores: (0, len(scores)))
    whole = kept(h.Extractor(W), pages)
    assert right(whole, pages)[0] < right(learned, pages)[0] and right(whole, pages)[1] < right(learned, pages)[1]
    assert sum(a != b for a, b in zip(whole, learned, strict=True)) >= len(pages) // 20


def test_time_grows_with_the_length():
    for piece in ("<div>x", "<div>x</b></i></p>", "<p><b>x", '<div class="a b">x', "<a href=x>x", "<li><ul>x", "x &amp; "):
        began = time.perf_counter()
        h.extract(piece * 2_000, W)
        short = time.perf_counter() - began
        began = time.perf_counter()
        h.extract(piece * 20_000, W)
        assert time.perf_counter() - began < 0.5 + 40 * short, piece


BY_READERS = "<div><b>Ann</b><p>I really liked this one, thank you for it.</p></div><div><b>Bob</b><p>Not sure I agree with any of it.</p></div>"
LISTED = "<li><p>I really liked this one, thank you for it.</p></li><li><p>Not sure I agree.</p></li>"


@pytest.mark.parametrize("body", [
    f'<article><h1>Big news</h1>{STORY}</article><div class="post-comments"><h3>Two comments</h3>{BY_READERS}</div>',
    f'<article><h1>Big news</h1>{STORY}</article><div id="disqus_thread">{BY_READERS}</div>',
    f'<div class="content"><h1>Big news</h1>{STORY}<div class="comment-list">{BY_READERS}</div></div>',
    f'<div class="content"><h1>Big news</h1>{STORY}<h3>Comments</h3><ul>{LISTED}</ul></div>',
    f"<article><h1>Big news</h1>{STORY}</article><h3>Comments</h3><ul>{LISTED}</ul>",
    f'<article><h1>Big news</h1>{STORY}</article><div class="related-posts"><h4>Related</h4><ul><li><a href=/a>Other story</a></li><li><a href=/b>Third story</a></li></ul></div>',
    f'<article><h1>Big news</h1>{STORY}<div class="related-posts"><a href=/a>Other story here</a> <a href=/b>Third story</a></div></article>',
    f'<article><h1>Big news</h1>{STORY}</article><p class="copyright">Copyright 2024 Example Media. All rights reserved.</p>',
])
def test_comments_related_and_copyright_go(body):
    page = f"<html><head><title>x</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>{body}</body></html>"
    assert h.extract(page, W) == f"Big news {TOLD}"


def test_quotes_open_a_value_only_after_an_equals_sign():
    assert h.extract("<p title=it's>text</p><p>it's more</p>", W) == "text it's more"
    assert h.extract("<p data-a='x>y' b = \"z>\" c'>one</p>", W) == "one"
    assert h.extract('<p title="open>one</p><p>two</p>', W) == "one two"
