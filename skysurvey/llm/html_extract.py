"""Main-text extraction by a recurrent block labeller.

Method: a page is cut into its leaf sequence of text blocks. Each block has a vector of
its tag path (hashed names, classes and ids of the open elements), a vector of its hashed
words and a few measures. A bidirectional LSTM in numpy reads the whole sequence, so
every block's label depends on the document around it; blocks labelled as article make
the text. The weights are trained by ``html_train`` on generated pages and ship with
the package, so results do not depend on the input table.

Blocks end where a block-level element begins or ends. Comments, scripts, styles and
other raw text never become blocks, nor do closed select, template, noscript and MathML
annotation elements; the text of math, svg and object elements is text like any other.
Character references are decoded, white space in a block becomes one blank, blocks are
joined by a line feed in page order.

Defined results: null or empty html, and pages without an article block, give the empty
string; broken markup is read as far as it goes (an unclosed comment, script or other raw
element ends with the page; of other hidden elements only the tag is left out); pages
of any length are read whole; repeated rows are extracted each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import io
import pkgutil
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysurvey.llm.common import map_columns

PATHS, PATH_SIZE = 1024, 16
WORDS, WORD_SIZE = 1024, 8
MEASURES = 8
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
HIDDEN = 16
#: Pages whose sequences are read together, and blocks of such a batch at most (padding included).
BATCH = 64
BATCH_BLOCKS = 20_000

#: Raw text, which without a closing tag ends with the page.
_RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<({_RAW})(?=[\s/>])[^>]*>(?:.*?</\1\s*>|.*\Z)|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements that are not shown as text; without a closing tag only their own tag is left out.
_HIDDEN = {t: re.compile(rf"</{t}\s*>", re.I) for t in "select template noscript annotation annotation-xml".split()}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input button svg g tspan textpath path rect circle ellipse line polyline polygon defs use symbol image marker mask pattern filter stop clippath lineargradient radialgradient object param math".split()) | frozenset(
    "mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mstyle mpadded mphantom mspace merror menclose maction semantics annotation annotation-xml".split()
)
#: Elements that an element of the same kind closes when it begins.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("article aside body div footer form header main nav ol section table td th tr ul dl blockquote html".split())


class Block(NamedTuple):
    """A leaf of a page: its text, the different names on its path, those of its own element and how many of its characters are in links."""

    text: str
    path: tuple[str, ...]
    own: tuple[str, ...]
    linked: int


def _open(tag: str, source: str) -> tuple[str, ...]:
    """An element's name and the words of its class, id and role."""
    names = [tag]
    if "=" in source:
        for m in _MARKS.finditer(source):
            names += ["." + w.lower() for w in _PARTS.findall(m[2] or m[3] or m[4] or "")]
    return tuple(names)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = [0]

    def end() -> None:
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                path = tuple(dict.fromkeys(n for _, names in stack for n in names))
                found.append(Block(text, path, stack[-1][1] if stack else (), min(linked[0], len(text))))
            pieces.clear()
            linked[0] = 0

    at = 0
    links = 0
    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if links:
                linked[0] += len(piece)
        at = m.end()
        source = m[0]
        if m[1] or source[1] in "!?":
            continue
        tag = _NAME.match(source)[1].lower()
        if tag in _HIDDEN and tag not in unclosed and source[1] != "/" and not source.endswith("/>"):
            closing = _HIDDEN[tag].search(page, at)
            if closing:
                at = closing.end()
                continue
            unclosed.add(tag)
        if tag in _INLINE:
            if tag == "a":
                links = 0 if source[1] == "/" else 1
            elif tag in ("br", "tspan"):
                pieces.append(" ")
            continue
        end()
        links = 0
        if source[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID and not source.endswith("/>"):
            closes = _CLOSES.get(tag)
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in _FENCE and stack[i][0] not in closes:
                        break
            stack.append((tag, _open(tag, source)))
    if at < len(page):
        rest = page[at:]
        # A tag that the page's end cuts off is not text.
        cut = rest.rfind("<")
        pieces.append(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!?]", rest[cut:]) else rest)
    end()
    return found


class Encoded(NamedTuple):
    """A page's blocks as rows of the embedding tables, with measures."""

    paths: np.ndarray
    path_of: np.ndarray
    words: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray


@lru_cache(maxsize=20_000)
def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


def encode(page: list[Block]) -> Encoded:
    paths, path_of, words, word_of = [], [], [], []
    measures = np.zeros((len(page), MEASURES), np.float32)
    total = sum(len(b.text) for b in page) or 1
    before = 0
    for i, b in enumerate(page):
        names = [_bucket(n, PATHS) for n in b.path]
        names += [_bucket("leaf " + n, PATHS) for n in b.own or ("",)]
        paths += names
        path_of += [i] * len(names)
        n = len(b.text)
        own = [zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in b.text.lower().split(" ")]
        words += own
        word_of += [i] * len(own)
        marks = sum(map(b.text.count, ".,;!?"))
        measures[i] = (min(np.log1p(n) / 6, 1.5), min(np.log1p(len(own)) / 5, 1.5), b.linked / n, marks / len(own), sum(map(b.text.count, "0123456789")) / n, before / total, i / len(page), n / total)
        before += n
    return Encoded(*(np.array(x, np.int64) for x in (paths, path_of, words, word_of)), measures)


def inputs(weights: dict[str, np.ndarray], page: Encoded) -> np.ndarray:
    """The blocks' input vectors: mean path vector, mean word vector, measures."""

    def mean(table: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        starts = np.searchsorted(of, np.arange(len(page.measures)))
        sums = np.add.reduceat(table[rows], starts, axis=0)
        return sums / np.diff(np.append(starts, len(of)))[:, None]

    return np.concatenate([mean(weights["paths"], page.paths, page.path_of) * 3, mean(weights["words"], page.words, page.word_of) * 3, page.measures], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States of an LSTM over x (time, batch, input); padding keeps the state."""
    time, batch, _ = x.shape
    pre = x.reshape(time * batch, -1) @ w + b
    pre = pre.reshape(time, batch, 4 * HIDDEN)
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((time, batch, HIDDEN), np.float32)
    for t in range(time):
        z = pre[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        cell = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c = np.where(m, cell, c)
        h = np.where(m, gates[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(cell), h)
        out[t] = h
    return out


def scores(weights: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of each block to be article text, for input vectors of several pages."""
    time = max(len(p) for p in pages)
    x = np.zeros((time, len(pages), INPUT), np.float32)
    mask = np.zeros((time, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = True
    ahead = lstm(x, mask, weights["wf"], weights["uf"], weights["bf"])
    back = lstm(x[::-1], mask[::-1], weights["wb"], weights["ub"], weights["bb"])[::-1]
    logit = np.concatenate([ahead, back, x], axis=2) @ weights["v"] + weights["d"]
    return [_sigmoid(logit[: len(p), i]) for i, p in enumerate(pages)]


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    data = np.load(io.BytesIO(pkgutil.get_data("skysurvey.llm", "html_model.npz")))
    return {k: data[k].astype(np.float32) for k in data.files}


def extract(pages: list[str], weights: dict[str, np.ndarray] | None = None, least: float = 0.5) -> list[str]:
    """The article text of every page."""
    weights = weights or trained()
    cut = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < BATCH and len(cut[order[to]]) * (to - at + 1) <= BATCH_BLOCKS:
            to += 1
        group = order[at:to]
        for i, p in zip(group, scores(weights, [inputs(weights, encode(cut[i])) for i in group])):
            out[i] = "\n".join([b.text for b, s in zip(cut[i], p.tolist()) if s >= least])
        at = to
    return out


def extract_pages(pages: DataFrame, least: float = 0.5, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text and n_chars."""
    kinds = (pages.schema[c].dataType.simpleString() for c in (key, url))
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(batch.column(2).to_pylist(), least=least)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    return map_columns(slim, "key {}, url {}, text string, n_chars bigint".format(*kinds), run).toDF(key, url, "text", "n_chars")


