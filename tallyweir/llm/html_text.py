"""Main text of web pages by a linear-chain conditional random field over the page's leaf blocks.

A block is a run of text between the borders of block elements. Its features are hashed: the tags and
the class and id words of its ancestors, its parent, and properties of its text. The weights are
fitted by gradient ascent on the likelihood of labelled pages; Viterbi finds the blocks of the
article in the order of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import least_by_hash, slices
from tallyweir.llm.html_pages import labelled_pages

# Fixed values of HTML: elements without an end tag, and those inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
# Elements whose text is never shown as text of the page.
UNSEEN = frozenset("script style noscript template title textarea select option svg math iframe object canvas audio video".split())
# An open element of the left is closed by a start tag of the right.
CLOSED_BY = {
    "p": frozenset("p h1 h2 h3 h4 h5 h6 div ul ol dl table form section article aside header footer nav main blockquote pre hr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("body div ul ol dl table td th tr article section aside nav main header footer form blockquote".split())
SECTIONS = frozenset("article aside footer form header main nav section".split())
NAME_WORDS = re.compile(r"[a-z]+")
LABEL = "data-main"

FEATURE_BITS = 13
STEPS, RATE, RIDGE = 250, 0.1, 3e-4
# Pages of the data, with an article element, that the model also learns from: those of smallest hash.
SAMPLE_PAGES = 300
# Of at most so many bytes each.
SAMPLE_PAGE_BYTES = 256 << 10
# And of at most so many features over all its blocks, which deep pages exceed.
SAMPLE_PAGE_FEATURES = 1 << 16


class Link(NamedTuple):
    """What an element adds to the features of the elements around it."""

    above: int
    added: tuple[int, ...]
    size: int  # with all links above


class Block(NamedTuple):
    """A block; the features of its ancestors are links that blocks of a page share."""

    text: str
    own: tuple[int, ...]
    label: int
    link: int
    links: list[Link]

    @property
    def features(self) -> tuple[int, ...]:
        found, at = list(self.own), self.link
        while at:
            found += self.links[at].added
            at = self.links[at].above
        return tuple(found)

    @property
    def size(self) -> int:
        return len(self.own) + self.links[self.link].size


def _hashed(name: str) -> int:
    return crc32(name.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1)


class _Frame(NamedTuple):
    tag: str
    section: str  # the nearest section element, or element with a name, around a block
    link: int
    label: int


class _Blocks(HTMLParser):
    """Every tag takes constant time on average, however deep or broken the page: open elements are found by their tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Frame("", "", 0, 0)]
        self.chain = [Link(0, (), 0)]
        self.around: set[int] = set()  # features of all open elements
        # Depths of open elements, the innermost last: by tag, those no implied end crosses, and those not inside a line.
        self.open: dict[str, list[int]] = {}
        self.scopes, self.outer = [0], [0]
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.unseen = 0
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_block()
        if tag in VOID:
            return
        ended = max((self.open[t][-1] for t, by in CLOSED_BY.items() if tag in by and self.open.get(t)), default=0)
        if ended > self.scopes[-1]:
            self._pop(ended)
        above = self.stack[-1]
        label, names, section = above.label, [] if tag in INLINE else [f"in {tag}"], tag if tag in SECTIONS else above.section
        for key, value in attrs:
            if key == LABEL:
                label = int(value == "1")
            elif key in ("class", "id", "role") and value and tag not in INLINE:
                found = NAME_WORDS.findall(value.lower())
                names += [f"named {w}" for w in found]
                section = found[0] if found and key != "role" else section
        link, new = above.link, {_hashed(n) for n in names} - self.around
        if new:
            self.chain.append(Link(above.link, tuple(sorted(new)), self.chain[above.link].size + len(new)))
            link = len(self.chain) - 1
            self.around |= new
        depth = len(self.stack)
        self.stack.append(_Frame(tag, section, link, label))
        self.open.setdefault(tag, []).append(depth)
        if tag in SCOPES and tag not in CLOSED_BY:
            self.scopes.append(depth)
        if tag not in INLINE:
            self.outer.append(depth)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_block()
        opened = self.open.get(tag)
        if opened and (tag not in INLINE or opened[-1] > self.outer[-1]):
            self._pop(opened[-1])

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            frame = self.stack.pop()
            self.open[frame.tag].pop()
            if frame.link != self.stack[-1].link:
                self.around.difference_update(self.chain[frame.link].added)
            self.unseen -= frame.tag in UNSEEN
            self.links -= frame.tag == "a"
        for depths in (self.scopes, self.outer):
            while depths[-1] >= depth:
                depths.pop()

    def handle_data(self, data):
        if not self.unseen:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)

    def _end_block(self):
        if self.pieces:
            whole = "".join(self.pieces)
            text = " ".join(whole.split())
            if text:
                frame = self.stack[self.outer[-1]]
                own = self._features(text, frame, self.linked / len(whole))
                self.blocks.append(Block(text, own, self.stack[-1].label, frame.link, self.chain))
            self.pieces, self.linked = [], 0

    def _features(self, text: str, frame: _Frame, linked: float) -> tuple[int, ...]:
        words = text.count(" ") + 1
        own = (
            f"parent {frame.tag}", f"section {frame.section}", f"{frame.tag} of section {frame.section}", f"words {min(words.bit_length(), 8)}", f"linked {int(linked * 4)}",
            f"stops {min(sum(map(text.count, '.,;!?')), 4)}", f"mark {'©' in text or '|' in text}", "any",
        )
        return tuple(map(_hashed, own))

    def close(self):
        super().close()
        self._end_block()


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; a null or empty page has none."""
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    return parser.blocks


class Model(NamedTuple):
    """Log-odds of a block by feature, and of a block after the label before it."""

    weights: np.ndarray
    moves: np.ndarray  # (before, label); before 2 is the page's start


def _flat(pages: Iterable[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all blocks, each feature's block, and the pages' block counts."""
    blocks = [b for page in pages for b in page]
    sizes = np.array([b.size for b in blocks], np.int64)
    features = np.fromiter((f for b in blocks for f in b.features), np.int64, int(sizes.sum()))
    return features, np.repeat(np.arange(len(blocks)), sizes), sizes


def page_scores(weights: list[float], page: list[Block]) -> list[float]:
    """Scores of a page's blocks; what an element adds is summed once for all blocks below it."""
    around: list[float] = []
    for link in page[0].links if page else ():
        around.append((around[link.above] if around else 0.0) + sum(weights[f] for f in link.added))
    return [around[b.link] + sum(weights[f] for f in b.own) for b in page]


def _scores(weights: np.ndarray, features: np.ndarray, owner: np.ndarray, blocks: int) -> np.ndarray:
    return np.bincount(owner, weights[features], minlength=blocks)


def fit(pages: list[list[Block]], steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by Adam; expectations by forward-backward over all pages side by side."""
    pages = [p for p in pages if p]
    weights, moves = np.zeros(1 << FEATURE_BITS), np.zeros((3, 2))
    if not pages:
        return Model(weights, moves)
    features, owner, sizes = _flat(pages)
    total = len(sizes)
    labels = np.array([b.label for page in pages for b in page])
    counts = np.array([len(p) for p in pages])
    order = np.argsort(-counts, kind="stable")
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    first = np.zeros(total, bool)
    first[starts] = True
    before = np.where(first, 2, np.roll(labels, 1))
    seen = np.zeros((3, 2))
    np.add.at(seen, (before, labels), 1)
    active = [int(n) for n in (counts[:, None] > np.arange(counts[0])).sum(axis=0)]
    momentum, spread = np.zeros(weights.size + 6), np.zeros(weights.size + 6)
    for step in range(1, steps + 1):
        emit = np.stack((np.zeros(total), _scores(weights, features, owner, total)), axis=1)
        forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
        forward[starts] = moves[2] + emit[starts]
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            forward[at] = np.logaddexp.reduce(forward[at - 1][:, :, None] + moves[:2], axis=1) + emit[at]
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            backward[at - 1] = np.logaddexp.reduce(moves[:2] + (emit[at] + backward[at])[:, None, :], axis=2)
        log_z = np.logaddexp.reduce(forward + backward, axis=1)
        share = np.exp(forward + backward - log_z[:, None])
        rest = np.flatnonzero(~first)
        pair = forward[rest - 1][:, :, None] + moves[:2] + (emit[rest] + backward[rest])[:, None, :] - log_z[rest][:, None, None]
        expected = np.vstack((np.exp(pair).sum(axis=0), share[first].sum(axis=0)))
        gradient = np.concatenate((
            np.bincount(features, (labels - share[:, 1])[owner], minlength=weights.size) / total - RIDGE * weights,
            ((seen - expected) / total - RIDGE * moves).ravel(),
        ))
        momentum = 0.9 * momentum + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        change = RATE * (momentum / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
        weights, moves = weights + change[:-6], moves + change[-6:].reshape(3, 2)
    return Model(weights, moves)


def decode(model: Model, scores: list[float]) -> list[int]:
    """Labels of one page's blocks by Viterbi; of equal paths the one through fewer article blocks."""
    if not scores:
        return []
    (stay0, enter), (leave, stay1), (start0, start1) = model.moves.tolist()
    zero, one = start0, start1 + scores[0]
    came = []
    for score in scores[1:]:
        from0 = (zero + stay0 < one + leave, zero + enter < one + stay1)
        zero, one = max(zero + stay0, one + leave), max(zero + enter, one + stay1) + score
        came.append(from0)
    label = int(one > zero)
    labels = [label]
    for choice in reversed(came):
        label = int(choice[label])
        labels.append(label)
    return labels[::-1]


def train(pages: DataFrame | None = None, sample_pages: int = SAMPLE_PAGES) -> Model:
    """The model of the labelled pages and, if given, of ``sample_pages`` different ``pages`` with an article element.

    In those, blocks in the article and in no menu, header, footer, aside or form are the main text. Pages
    of more than ``SAMPLE_PAGE_BYTES`` or ``SAMPLE_PAGE_FEATURES`` are not learned from, so that the sample
    is bounded in memory; null pages have no article.
    """
    labelled = [blocks_of(page) for page in labelled_pages()]
    if pages is not None:
        marked = pages.select("html").where(F.contains("html", F.lit("<article")) & (F.octet_length("html") <= SAMPLE_PAGE_BYTES))
        for row in least_by_hash(marked, sample_pages, "html").collect():
            page = re.sub(r"<(nav|header|footer|aside|form)\b", rf'<\1 {LABEL}="0"', row.html)
            blocks = blocks_of(re.sub(r"<article\b", f'<article {LABEL}="1"', page))
            if sum(b.size for b in blocks) <= SAMPLE_PAGE_FEATURES:
                labelled.append(blocks)
    return fit(labelled)


def _extracted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    weights = model.weights.tolist()
    for batch in batches:
        for rows in slices(batch, "html"):
            texts, kept = [], []
            for html in rows.column("html").to_pylist():
                page = blocks_of(html)
                main = [b.text for b, label in zip(page, decode(model, page_scores(weights, page)), strict=True) if label]
                texts.append(" ".join(main))
                kept.append(len(main))
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(kept, pa.int32())],
                names=["page_id", "url", "text", "n_blocks"],
            )


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` of every row of ``pages`` (page_id, url, html).

    The main text's blocks in page order, white space inside each as one space, joined by one space.
    A null or empty page, or one without main text, gives an empty text. Pages of any length are read
    whole; broken or deep markup is read as far as it goes, in time and memory that grow with its length; repeated rows are extracted each; other columns
    are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    found = pages.select("page_id", "url", "html").mapInArrow(
        lambda batches: _extracted(batches, sent.value), "page_id bigint, url string, text string, n_blocks int"
    )
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
