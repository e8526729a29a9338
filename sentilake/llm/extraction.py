"""Main text of HTML pages by the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentilake.llm.common import bounded_batches, own_columns
from sentilake.llm.page_blocks import HEADINGS, PARTS, Block, parse
from sentilake.llm.page_examples import labelled_examples

#: Pages of the table, at most, that add their labels to those of the examples.
SAMPLE_PAGES = 2000
#: A word scores between these bounds; a tag between ``-LEAST_TAG - TAG_RANGE`` and ``-LEAST_TAG``.
MOST_WORD = 4.0
LEAST_TAG, TAG_RANGE = 0.1, 0.6
RIDGE = 1.0
#: A form of this many words that outweighs the rest is taken for a wrapper of the whole page.
PAGE_FORM = 100
STEPS = 50

_TAGS = ("p", "li", "td", "other")
_SIZES = (3, 10, 30)
FEATURES = ("bias", "article", "content", *PARTS, "heading", *_TAGS, "linked", "sentence", *[f"under_{n}" for n in _SIZES])
_BIT = {name: 1 << n for n, name in enumerate(FEATURES)}
_KNOWN_TAGS = frozenset(
    "a article aside b blockquote body br button dd div dl dt em figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i "
    "img input label li link main meta nav ol option p pre script section select small span strong style table tbody td th thead "
    "title tr ul".split()
)


@dataclass(frozen=True)
class Weights:
    """Scores learned from labelled pages: per feature of a block, and per tag."""

    words: tuple[float, ...]
    tags: dict[str, float]

    def of_block(self, features: int) -> float:
        score = sum(w for n, w in enumerate(self.words) if features >> n & 1)
        return max(-MOST_WORD, min(MOST_WORD, score))

    def of_tag(self, name: str) -> float:
        return self.tags.get(name if name in _KNOWN_TAGS else "", -LEAST_TAG - TAG_RANGE / 2)


def block_features(block: Block, text: str) -> int:
    """The features of a block as bits."""
    size = text.count(" ") + 1
    bits = _BIT["bias"]
    bits |= _BIT["article"] if block.in_article else 0
    bits |= _BIT["content"] if block.in_content else 0
    for part in block.parts:
        bits |= _BIT[part]
    if block.tag in HEADINGS:
        bits |= _BIT["heading"]
    else:
        tag = "td" if block.tag == "th" else block.tag
        bits |= _BIT[tag if tag in _TAGS else "other"]
    bits |= _BIT["linked"] if 2 * block.linked > size else 0
    bits |= _BIT["sentence"] if text[-1] in ".!?…。" else 0
    for limit in _SIZES:
        bits |= _BIT[f"under_{limit}"] if size < limit else 0
    return bits


def label_counts(page: str, spans: Iterable[tuple[int, int]]) -> Counter[tuple[str, str, bool]]:
    """How often blocks of given features, and tags, stand inside and outside the main text.

    Blocks count once with all features and once each without the marks of article and content, so
    that pages without such marks are learned from too.
    """
    spans = list(spans)
    counts: Counter[tuple[str, str, bool]] = Counter()

    def inside(at: int) -> bool:
        return any(start <= at < end for start, end in spans)

    blocks, tags = parse(page)
    for block in blocks:
        text = block.text()
        if text:
            bits = block_features(block, text)
            label = inside(block.start) and not block.parts
            for seen in (bits, bits & ~_BIT["article"], bits & ~_BIT["article"] & ~_BIT["content"]):
                counts["block", str(seen), label] += 1
    for at, name, *_ in tags:
        counts["tag", name if name in _KNOWN_TAGS else "", inside(at)] += 1
    return counts


def article_span(page: str) -> list[tuple[int, int]]:
    """The weak label of a page: its only article element, or its only main element; else none."""
    tags = parse(page)[1]
    for wanted in ("article", "main"):
        places = [at for at, name, *_ in tags if name == wanted]
        if len(places) == 2 and page[places[1] + 1] == "/" and page[places[0] + 1] != "/":
            return [(places[0], places[1])]
    return []


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str, bool]] = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            spans = article_span(page or "")
            if spans:
                counts.update(label_counts(page, spans))
    rows = [(*key, n) for key, n in counts.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "key", "inside", "n"]
    )


def learn(counts: Counter[tuple[str, str, bool]]) -> Weights:
    """Logistic regression (ridge, Newton steps) over the blocks' features; a smoothed share per tag."""
    rows = [(int(key), label, n) for (kind, key, label), n in sorted(counts.items()) if kind == "block"]
    x = np.array([[bits >> f & 1 for f in range(len(FEATURES))] for bits, _, _ in rows], float)
    y = np.array([label for _, label, _ in rows], float)
    n = np.array([n for _, _, n in rows], float)
    w = np.zeros(len(FEATURES))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - RIDGE * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    outside = {name: (counts["tag", name, False], counts["tag", name, True]) for name in (*_KNOWN_TAGS, "")}
    tags = {name: -LEAST_TAG - TAG_RANGE * (out + 1) / (out + within + 2) for name, (out, within) in outside.items()}
    return Weights(tuple(w.tolist()), tags)


def fit_weights(pages: DataFrame | None = None, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from the labelled examples and, if a table is given, from up to ``sample`` of its pages.

    The sample is that of smallest hash of id and page length. Its pages label themselves: where there is exactly one
    article (or main) element, that is the main text; the others teach nothing. Counts of (features, label) come
    back to the driver: as many rows as combinations of features.
    """
    counts: Counter[tuple[str, str, bool]] = Counter()
    for page, spans in labelled_examples():
        counts.update(label_counts(page, spans))
    if pages is not None:
        html = F.col(html_column)
        key = F.xxhash64(F.col(id_column).cast("string"), F.length(html))
        # The cut is found on hashes alone; pages are read again only where they lie below it.
        keys = pages.select(key.alias("k")).orderBy("k").limit(sample).agg(F.max("k")).first()[0]
        chosen = pages.filter(key <= keys).select(html.alias("html")) if keys is not None else pages.limit(0).select(html.alias("html"))
        bounded_batches(pages.sparkSession)
        found = chosen.mapInArrow(_label_batches, "kind string, key string, inside boolean, n long")
        for row in found.groupBy("kind", "key", "inside").agg(F.sum("n").alias("n")).collect():
            counts[row.kind, row.key, row.inside] += row.n
    return learn(counts)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of highest sum, by one scan; empty if no sum is above zero.

    Of equal sums the first and longest wins.
    """
    best, bounds = 0.0, (0, 0)
    total, start = 0.0, 0
    for n, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, n
        total += score
        if total > best or (total == best > 0 and start == bounds[0]):
            best, bounds = total, (start, n + 1)
    return bounds


def _unwrap(blocks: list[Block], texts: list[str]) -> None:
    """A form that holds most of a longer page wraps the page: it is no part of it."""
    of_form = sum(text.count(" ") + 1 for block, text in zip(blocks, texts, strict=True) if block.parts == {"form"})
    rest = sum(text.count(" ") + 1 for block, text in zip(blocks, texts, strict=True) if text and not block.parts)
    if of_form >= PAGE_FORM and of_form > rest:
        for block in blocks:
            block.parts -= {"form"}


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of one page: blocks of the best region that are part of no menu, header, footer and the like."""
    blocks, tags = parse(page or "")
    scores: list[float] = []
    where: list[int] = []
    texts = [block.text() for block in blocks]
    _unwrap(blocks, texts)
    known: dict[int, float] = {}
    at = 0
    for _, name, before, cut in [*tags, (0, "", len(blocks), False)]:
        for n in range(at, before):
            if texts[n]:
                bits = block_features(blocks[n], texts[n])
                if bits not in known:
                    known[bits] = weights.of_block(bits)
                # A block's words score alike, so the best region never cuts a block.
                scores.append(0.0 if blocks[n].cut() else known[bits] * (texts[n].count(" ") + 1))
                where.append(n)
        at = max(at, before)
        scores.append(0.0 if cut else weights.of_tag(name))
        where.append(-1)
    start, end = best_stretch(scores)
    return " ".join(texts[n] for n in where[start:end] if n >= 0 and not blocks[n].parts)


def _text_batches(weights: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(0).to_pylist()]
            rest = [batch.column(n) for n in range(1, batch.num_columns)]
            columns = [*rest, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{n}" for n in range(len(columns))])

    return run


def extract_main_text(
    pages: DataFrame,
    id_column: str = "page_id",
    html_column: str = "html",
    weights: Weights | None = None,
    text: str = "text",
) -> DataFrame:
    """All columns of ``pages`` but the page itself, and its main text as column ``text``.

    Every word of a page scores by the learned chance that its block is main text, every tag scores below
    zero, and one scan finds the contiguous stretch of highest sum. Within it, blocks in menus, headers, footers, sidebars, notices, adverts,
    forms, share bars, comments, scripts and styles go. Character references are decoded, white space in a block becomes one space,
    blocks are joined by one space. A null or empty page, and one without main text, has the text ''. Rows stay as they are, repeated
    and null ids too; a column named as the result is replaced. Whole pages are read, whatever their length. Map-side only.
    """
    if weights is None:
        weights = fit_weights(pages, id_column, html_column)
    bounded_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html_column, text)]
    page = F.col(html_column).cast("string")
    # Names may hold any sign: inside, columns go by their number.
    kept = [c.alias(f"c{n}") for n, (c, name) in enumerate(zip(own_columns(pages), pages.columns, strict=True)) if name in rest]
    kinds = [pages.schema[name].dataType for name in rest]
    schema = T.StructType([T.StructField(f"c{n}", kind) for n, kind in enumerate([*kinds, T.StringType()])])
    found = pages.select(page.alias("page"), *kept).mapInArrow(_text_batches(weights), schema)
    return found.toDF(*rest, text)
