"""Main text of web pages by minimum cuts.

Each text block is a node. A classifier's log odds that it is content become the capacity of its edge
to the source or the sink; neighbours in page order and blocks of one parent are joined by edges whose
capacity falls with their distance in the tree. A maximum flow finds the cheapest labelling:
what the source still reaches is content.

The classifier is naive Bayes over the look of a block (length, links, punctuation, element), trained
on blocks that say themselves what they are, in a bounded sample of the pages. Elements and class
names that say it outright add fixed evidence.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.html_blocks import Block, Element, blocks

SAMPLE_PAGES = 2000
STATED = 8.0
LOOK_LIMIT = 4.0
NEAR, FAR = 1.2, 0.8
_SCALE = 1000

#: Elements and class words that say what a part of a page is.
CONTENT_TAGS = frozenset(["article", "main"])
BOILERPLATE_TAGS = frozenset(
    "nav footer aside form menu fieldset dialog search select button".split()
)
ARTICLE_WORDS = frozenset("article post entry story articlebody blogpost".split())
CONTENT_WORDS = ARTICLE_WORDS | frozenset("content main body text".split())
READER_WORDS = frozenset(
    "comment comments reply replies disqus respond discussion commentlist commenter".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion "
    "banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login signin nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar rail footer masthead topbar toolbar share sharing social related recommended "
    "recommendations recirculation trending popular widget pagination pager tags copyright legal "
    "disclaimer skip search form widgets outbrain taboola contentinfo complementary".split()
)
WRAPPER_WORDS = frozenset("with has no without".split())
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")


def stated(element: Element | None) -> int:
    """What the elements around a block state: 1 content, -1 boilerplate, 0 nothing.

    Boilerplate elements and readers' comments count wherever they are; a boilerplate class may be
    a wrapper's, so an article inside it overrides it. Inside the article it counts, unless the class
    says that it is a wrapper's ("with-sidebar"). A header states boilerplate unless it is an
    article's own.
    """
    inside, boxed, verdict = False, False, 0
    while element is not None and element.tag not in ("body", "html"):
        tag, words = element.tag, element.words
        if tag in BOILERPLATE_TAGS or words & READER_WORDS:
            return -1
        if tag in CONTENT_TAGS:
            inside, verdict = True, -1 if boxed else 1
        elif not inside:
            if tag == "header" and not _within_article(element) or words & BOILERPLATE_WORDS:
                verdict = -1
                boxed = boxed or not words & WRAPPER_WORDS
            elif not verdict and words & CONTENT_WORDS:
                verdict = 1
        if tag in CONTENT_TAGS and words & BOILERPLATE_WORDS and not words & CONTENT_WORDS:
            return -1
        element = element.parent
    return verdict


def _within_article(element: Element) -> bool:
    while element is not None:
        if element.tag in CONTENT_TAGS or element.words & ARTICLE_WORDS:
            return True
        element = element.parent
    return False


def look(block: Block) -> list[str]:
    """Features of a block that do not depend on class names or landmarks; a bounded set."""
    text, size = block.text, len(block.text)
    sentences = len(_SENTENCE.findall(text))
    tag = block.element.tag
    kind = tag if tag in ("p", "li", "td", "pre", "blockquote", "div", "span", "a", "b") else (
        "heading" if re.fullmatch("h[1-6]", tag) else "other"
    )
    return [
        f"length {min(10, size.bit_length())}",
        f"links {min(4, int(5 * block.linked / max(1, size)))}",
        f"sentences {min(5, sentences)}",
        f"ends {text[-1:] in '.!?…。！？”»'}",
        f"element {kind}",
        f"commas {min(4, text.count(','))}",
    ]


@dataclass
class Classifier:
    """Log odds of content by feature; empty without training blocks."""

    weights: dict[str, float]

    def log_odds(self, block: Block) -> float:
        seen = sum(self.weights.get(f, 0.0) for f in look(block))
        said = stated(block.element)
        bounded = max(-LOOK_LIMIT, min(LOOK_LIMIT, seen))
        return STATED * said + bounded if said else bounded + self._plain(block)

    @staticmethod
    def _plain(block: Block) -> float:
        """A weak prior where nothing is stated: sentences are content, links are not."""
        size = len(block.text)
        return min(2.0, size / 60) - 0.5 - 3.0 * block.linked / max(1, size)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Classifier:
    """Naive Bayes from about ``sample_pages`` pages, those with the least hashes of their html."""
    rows = pages.filter(F.col("html").isNotNull())
    total = rows.count()
    if not total:
        return Classifier({})
    share = int(min(1.0, sample_pages / total) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], int] = {}
            for source in batch.column(0).to_pylist():
                for block in blocks(source):
                    said = stated(block.element)
                    for feature in look(block) if said else ():
                        seen[feature, said] = seen.get((feature, said), 0) + 1
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array([f for f, _ in seen], pa.string()),
                "said": pa.array([s for _, s in seen], pa.int32()),
                "n": pa.array(list(seen.values()), pa.int64()),
            })

    counts = (
        sample.select(F.col("html").cast("string")).mapInArrow(count, "feature string, said int, n bigint")
        .groupBy("feature", "said").agg(F.sum("n").alias("n")).collect()
    )
    by = {(r.feature, r.said): r.n for r in counts}
    groups: dict[str, list[str]] = {}
    for feature in {f for f, _ in by}:
        groups.setdefault(feature.split(" ")[0], []).append(feature)
    weights = {}
    for features in groups.values():
        sums = {s: sum(by.get((f, s), 0) for f in features) for s in (1, -1)}
        if not all(sums.values()):
            continue
        for f in features:
            weights[f] = math.log((by.get((f, 1), 0) + 1) / (sums[1] + len(features))) - math.log(
                (by.get((f, -1), 0) + 1) / (sums[-1] + len(features))
            )
    return Classifier(weights)


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(items: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: next block in the page, and next block under the same parent."""
    out, last = [], {}
    for i, block in enumerate(items):
        parent = block.element.parent or block.element
        if i:
            steps = tree_distance(items[i - 1].element, block.element)
            out.append((i - 1, i, NEAR / (1 + steps / 2)))
        before = last.get(parent.number)
        if before is not None and before != i - 1:
            out.append((before, i, FAR / 2))
        last[parent.number] = i
    return out


def source_side(gains: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source.

    ``gains[i]`` is what node ``i`` gains on the source side (negative: on the sink side), and each link
    costs its weight if it is cut. Nodes that may lie on either side at the same cost go to the sink.
    Maximum flow by shortest augmenting paths in layers (Dinic); whatever one node can send
    straight through is left out from the start, since ``gains`` are already net.
    """
    n = len(gains)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, gain in enumerate(gains):
        capacity = round(abs(gain) * _SCALE)
        if capacity:
            join(*((source, i) if gain > 0 else (i, sink)), capacity, 0)
    for a, b, weight in links:
        both = round(weight * _SCALE)
        if both:
            join(a, b, both, both)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for edge in head[node]:
                if room[edge] and level[to[edge]] < 0:
                    level[to[edge]] = level[node] + 1
                    queue.append(to[edge])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        used = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for edge in path:
                    room[edge] -= flow
                    room[edge ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not room[e])
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while used[node] < len(head[node]):
                edge = head[node][used[node]]
                if room[edge] and level[to[edge]] == level[node] + 1:
                    path.append(edge)
                    node = to[edge]
                    break
                used[node] += 1
            else:
                if not path:
                    break
                edge = path.pop()
                node = to[edge ^ 1]
                used[node] += 1


def main_text(source: str | None, classifier: Classifier) -> str:
    """The content blocks of one page, one a line."""
    items = blocks(source or "")
    if not items:
        return ""
    gains = [classifier.log_odds(b) for b in items]
    kept = source_side(gains, edges(items))
    return "\n".join(b.text for b, k in zip(items, kept) if k)


def extracted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A null or empty html, and a page without content, give an empty text. The whole html is read,
    however long; repeated rows each get a row; null ids and urls stay null. Extra columns are
    ignored; an empty table gives an empty result.
    """
    classifier = train(pages, sample_pages)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py(), classifier) for s in batch.column(2)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes)],
                ["page_id", "url", "text", "n_chars"],
            )

    columns = ("url", "html")
    return pages.select("page_id", *[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(
        task, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    )
