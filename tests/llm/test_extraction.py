"""Main text: hand-made pages, held-out layouts, and the pages of the smallest table by a plain rule."""

import html
import random
import re

import pytest

from sentilake.llm import extraction, page_blocks, page_examples
from sentilake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def weights():
    return extraction.fit_weights()


LONG = "This is the first sentence of a longer paragraph, which goes on for quite some time so that it looks like prose."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("<html><body></body></html>", ""),
        ("plain words only", "plain words only"),
        ("a < b and b > c &amp; d", "a < b and b > c & d"),
        ("<article><h1>Title</h1><p>One.</p></article>", "Title One."),
        ("<p>R&eacute;sum&#233; &#x26; &lt;b&gt;&nbsp;x</p>", "Résumé & <b> x"),
        ("<article><p>one<b>two</b> <i>three</i>\n four<br>five</p></article>", "onetwo three four five"),
        ("<article><p>a<script>var x = '<p>no</p>';</script>b</p><style>p{}</style><!-- no <p>x</p> --></article>", "ab"),
        ('<article><p title="a > b">yes</p></article>', "yes"),
        ("<article><p>yes</p><p <", "yes"),
        ("<article><p>yes</p><!-- no", "yes"),
        ("<ARTICLE><P>Upper case</P></ARTICLE><FOOTER>no</FOOTER>", "Upper case"),
        (f"<nav><ul><li><a href=/a>A</a></li></ul></nav><article><p>{LONG}</p></article><footer>&copy; x</footer>", LONG),
        (f"<div><div class='cookie-banner'>{LONG} {LONG}</div><article><p>{LONG}</p></article></div>", LONG),
        (f"<main><p>{LONG}</p><aside>No {LONG}</aside><p>And so on.</p></main>", f"{LONG} And so on."),
        (f"<article><p>{LONG}</p><form><label>No</label><button>Go</button></form><p>End.</p></article>", f"{LONG} End."),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p><footer>Tags</footer></article>", f"Head {LONG}"),
        (f"<article><p>{LONG}</p></article><div id=comments><article class=comment><p>{LONG}</p></article></div>", LONG),
        (f"<article><p>{LONG}</p></article><section id='comments'>{f'<p>{LONG}</p>' * 9}</section>", LONG),
        (f"<div class='post'><h2>Head</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div>", f"Head {LONG} one two"),
        (f"<body class='has-sidebar'><form id=f><div><h1>Wrapped</h1><p>{' '.join([LONG] * 6)}</p></div></form></body>", f"Wrapped {' '.join([LONG] * 6)}"),
        (f"<article><p>{LONG}<p><b>Open.<br><p>{LONG}</article><footer>no", f"{LONG} Open. {LONG}"),
        (f"<table><tr><td><a href=/>Home</a><td>{LONG}<br>{LONG}</table>", f"{LONG} {LONG}"),
    ],
)
def test_pages_by_hand(weights, page, want):
    assert extraction.main_text(page, weights) == want


def test_held_out_layouts():
    """Weights of all other layouts extract a layout's main text: measured by words found and words wrongly taken."""
    examples = page_examples.labelled_examples(6)
    layouts = len(page_examples.LAYOUTS)
    hit = extra = whole = 0
    for left_out in range(layouts):
        counts = sum((extraction.label_counts(*e) for n, e in enumerate(examples) if n % layouts != left_out), start=extraction.Counter())
        weights = extraction.learn(counts)
        for page, spans in examples[left_out::layouts]:
            want = " ".join(re.sub("<[^>]*>", " ", page[s:e]) for s, e in spans).split()
            got = extraction.main_text(page, weights).split()
            whole += len(want)
            hit += sum((extraction.Counter(want) & extraction.Counter(got)).values())
            extra += len(got) - sum((extraction.Counter(want) & extraction.Counter(got)).values())
    assert hit / whole > 0.97 and extra / whole < 0.03, (hit / whole, extra / whole)


def test_best_stretch_equals_all_sums():
    rng = random.Random(1)
    for _ in range(300):
        scores = [float(rng.randint(-4, 4)) for _ in range(rng.randint(0, 12))]
        start, end = extraction.best_stretch(scores)
        sums = [sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)]
        assert sum(scores[start:end]) == max(sums)


def test_one_pass_over_long_and_broken_pages(weights):
    """Time in proportion to the page: neither unclosed elements nor stray end tags cost the square."""
    for piece in ("<b>x<br>", "</i>", "<div>", "<a title='", "<!--", "<li>y", '<p class="a', "<", "</", "&"):
        page_blocks.parse(piece * 50_000)
    page = f"<article>{f'<p>{LONG}</p>' * 5000}</article>"
    assert extraction.main_text(page, weights) == " ".join([LONG] * 5000)


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "mine", 5), (1, None, None, None, None), (None, "v", "", "x", 2)]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `a b` int")
    got = extraction.extract_main_text(pages)
    assert set(got.columns) == {"page_id", "url", "a b", "text"}
    assert sorted(map(str, got.select("page_id", "url", "a b", "text").collect())) == sorted(
        map(str, spark.createDataFrame([(1, "u", 5, LONG), (1, None, None, ""), (None, "v", 2, ""), (1, "u", 5, LONG)], "page_id long, url string, `a b` int, text string").collect())
    )
    assert extraction.extract_main_text(pages.limit(0)).count() == 0
    assert extraction.extract_main_text(pages.select("page_id", "html")).count() == 4


def test_query_takes_what_stands_in_the_article(spark):
    sf = "/root/testdata/sf0.001"
    want = set()
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)>", " ", re.sub(r"</?b>", "", body))).split())
        want.add((row.page_id, row.url, text, len(text)))
    assert {tuple(r) for r in QUERIES["op12_main_text"].run(spark, sf).collect()} == want
