"""Main text of web pages: the maximum-scoring run of tokens, with weights from labelled pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import small_batches
from canonry.llm.labelled_pages import labelled_pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|(?=<)|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SENTENCE = re.compile(r"[.!?;:…。！？](?:\s|$|[\"'”’)»])")
# Fixed values of HTML: elements without an end, elements whose content is not text of the page, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg select option button audio video".split())
OPEN_ENDED = frozenset("select option button svg audio video".split())  # without an end tag, only the tag itself goes
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
BOUNDS = ("div", "article", "main", "section", "nav")
ARTICLE = ("article", "main")
#: Parts whose class, id and role are read; names of headings, cells and inline elements speak of the text, not the part.
NAMED = frozenset("article aside body center dialog div dl fieldset footer form header main menu nav ol p section table ul".split())
#: Elements that mark a part by themselves; the others may hold anything.
TELLING = frozenset("article aside dialog fieldset footer form header label legend main menu nav".split())
SPLIT = re.compile(r"[^a-z0-9]+")
#: A block is out when the marks around it weigh this or less; a word scores between LEAST and MOST.
OUT, LEAST, MOST = -1.0, -2.0, 1.5
DEFAULT = 1.5  # log odds of a block without marks, when the marks are fitted
STEPS, RATE, RIDGE = 3000, 2.0, 2e-4


@dataclass
class Block:
    marks: frozenset[str]
    inside: bool  # in an article or main element
    kind: str  # the element it stands in
    text: list[str] = field(default_factory=list)
    linked: int = 0  # characters of it that are link text

    def words(self) -> str:
        return " ".join("".join(self.text).split())


@dataclass(slots=True)
class Open:
    name: str
    marks: frozenset[str]
    block: int  # place on the stack of the nearest block element, itself included
    paragraph: int  # place of the paragraph open in that block, or -1


def parse(page: str, known: frozenset[str] | None = None) -> list:
    """The page as tokens in order: ("tag", name, marks, inside) or ("text", Block).

    Unclosed and misplaced tags are repaired as far as it matters: an end closes up to its start, a block start closes
    an open paragraph, items and cells close their forerunner, and unclosed inline elements end with their block. Each
    open element keeps the marks around it (of those `known`), so that the time grows with the page, however deep.
    """
    tokens: list = []
    stack: list[Open] = []
    places: dict[str, list[int]] = {}
    endless: set[str] = set()
    block: Block | None = None
    at, n, none = 0, len(page), frozenset()

    def last(name: str) -> int:
        p = places.get(name)
        return p[-1] if p else -1

    def inside() -> bool:
        return bool(places.get("article") or places.get("main"))

    def text(s: str) -> None:
        nonlocal block
        if not s:
            return
        if block is None:
            if not s.strip():
                return
            k = stack[-1].block if stack else -1
            block = Block(stack[-1].marks if stack else none, inside(), stack[k].name if k >= 0 else "body")
            tokens.append(("text", block))
        s = html.unescape(s)
        block.text.append(s)
        if places.get("a"):
            block.linked += len(s)

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().name].pop()

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            tail = page[at:]
            k = tail.rfind("<")
            text(tail[:k] if k >= 0 and re.match(r"</?[a-zA-Z!]", tail[k:]) else tail)
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        around = stack[-1].marks if stack else none
        if m[1]:
            k = last(name)
            if name in BLOCKS:
                block = None
                if k >= 0:
                    cut(k)
            elif k >= 0 and k > stack[-1].block:
                cut(k)
            tokens.append(("tag", name, around, inside()))
            continue
        attrs = m[3] or ""
        if name in RAW and not attrs.rstrip().endswith("/"):
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = at if name in OPEN_ENDED else n
            tokens.append(("tag", name, around, inside()))
            continue
        if name in ("br", "img"):
            if block is not None:
                block.text.append(" ")
        elif name in BLOCKS:
            block = None
            if name in CLOSES_P and stack and stack[-1].paragraph >= 0:
                cut(stack[-1].paragraph)
            if name in SIBLINGS:
                k = last(name)
                if k >= 0 and k > max(last(b) for b in (*SIBLINGS[name], *BOUNDS)):
                    cut(k)
        around = stack[-1].marks if stack else none
        if name not in VOID and not (attrs.endswith("/") and name not in BLOCKS):
            new = {name + ("@in" if name in ("header", "footer") and inside() else "")} if name in TELLING else set()
            if attrs:
                if name in NAMED:
                    for v in MARKS.findall(attrs):
                        v = "".join(v).lower()
                        new.update("." + x + ("@in" if x in ("header", "footer") and inside() else "") for x in (v.split() if name == "p" else SPLIT.split(v)) if x)
                if HIDDEN.search(attrs):
                    new.add(".hidden")
            if known is not None:
                new &= known
            top = len(stack)
            paragraph = top if name == "p" else -1 if name in BLOCKS else (stack[-1].paragraph if stack else -1)
            marks = around if new <= around else around | new
            stack.append(Open(name, marks, top if name in BLOCKS else (stack[-1].block if stack else -1), paragraph))
            places.setdefault(name, []).append(top)
        tokens.append(("tag", name, around, inside()))
    return tokens


def shape(block: Block, words: str) -> list[str]:
    """What a block looks like by itself: its element, length, share of link text and marks of sentences."""
    n = words.count(" ") + 1
    linked = block.linked / max(1, sum(map(len, block.text)))
    return [
        f"~{'heading' if block.kind in HEADINGS else block.kind if block.kind in ('p', 'li', 'td', 'pre', 'blockquote') else 'other'}",
        f"~words{0 if n < 4 else 1 if n < 15 else 2}",
        f"~links{0 if linked < 0.2 else 1 if linked < 0.7 else 2}",
        f"~sentence{int(bool(SENTENCE.search(words)))}",
    ]


@dataclass(frozen=True)
class Weights:
    bias: float
    marks: dict[str, float]  # never above 0: how far a mark puts what it surrounds outside
    words: dict[str, float]  # of a word that is not outside, by the marks around it and its block's shape
    tags: dict[tuple[str, bool], float]  # of a tag, in an article or not; never above -0.02


def has_article(tokens: list) -> bool:
    """Whether the page's article or main elements hold at least a fifth of its words; else they are cards or stubs."""
    count = Counter()
    for t in tokens:
        if t[0] == "text":
            count[t[1].inside] += len(t[1].words().split())
    return count[True] * 5 >= count[True] + count[False] and count[True] > 0


def context(block: Block, has: bool) -> frozenset[str]:
    return block.marks | {"@outside"} if has and not block.inside else block.marks


def _regression(rows: list[list[str]], labels: list[bool], offsets: np.ndarray, bias: float = 0.0, most: float = np.inf) -> tuple[dict[str, float], float]:
    """Weights of features that are there or not, by ridge-penalised logistic regression; the bias is fitted unless weights have an upper bound."""
    index: dict[str, int] = {}
    at = [[index.setdefault(f, len(index)) for f in r] for r in rows]
    x = np.zeros((len(rows), len(index)))
    for i, r in enumerate(at):
        x[i, r] = 1
    y, w = np.array(labels, float), np.zeros(len(index))
    for _ in range(STEPS):
        off = 1 / (1 + np.exp(-(x @ w + bias + offsets))) - y
        w = np.minimum(w - RATE * (x.T @ off / len(y) + RIDGE * w), most)
        if most == np.inf:
            bias -= RATE * off.mean()
    return {f: float(w[k]) for f, k in index.items()}, float(bias)


def fit_pages(pages: list[tuple[str, list[str]]]) -> Weights:
    """Marks that put outside, from all blocks (first those of elements, then standing beside the article, which would
    otherwise hide them); weights of words from the blocks left; log odds for tags."""
    rows, labels, shapes, beside = [], [], [], []
    tag_in, tag_out = Counter(), Counter()
    for page, main in pages:
        tokens, todo = parse(page), Counter(main)
        has, good = has_article(tokens), []
        for i, t in enumerate(tokens):
            if t[0] != "text" or not (words := t[1].words()):
                continue
            hit = todo[words] > 0
            todo[words] -= hit
            if hit:
                good.append(i)
            rows.append(sorted(t[1].marks))
            beside.append(["@outside"] if has and not t[1].inside else [])
            shapes.append(shape(t[1], words))
            labels.append(hit)
        for i, t in enumerate(tokens):
            if t[0] == "tag":
                (tag_in if good and good[0] <= i <= good[-1] else tag_out)[t[1], t[3]] += 1
    marks, _ = _regression(rows, labels, np.zeros(len(rows)), DEFAULT, 0.0)
    around = np.array([sum(marks[m] for m in r) for r in rows])
    marks |= _regression(beside, labels, around, DEFAULT, 0.0)[0]
    around = np.array([sum(marks[m] for m in (*r, *b)) for r, b in zip(rows, beside)])
    left = np.flatnonzero(around > OUT)
    words, bias = _regression([rows[i] + shapes[i] for i in left], [labels[i] for i in left], np.zeros(len(left)))
    t_in, t_out = sum(tag_in.values()) + 1, sum(tag_out.values()) + 1
    tags = {t: min(-0.02, max(-1.0, log((tag_in[t] + 0.5) / t_in) - log((tag_out[t] + 0.5) / t_out))) for t in sorted(tag_in.keys() | tag_out.keys())}
    return Weights(bias, marks, words, tags)


@lru_cache(maxsize=1)
def fit() -> Weights:
    return fit_pages(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the run with the largest sum, the first of equal ones and the shorter at its start; (0, 0) if no sum is positive."""
    best, a, b, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best + 1e-9:
            best, a, b = run, start, i + 1
    return a, b


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The page's main text: blocks joined by one newline, empty if there is none.

    Every word scores by what stands around it and by its block's shape, every tag negatively; a linear scan finds the
    run of tokens with the largest sum (of equal ones the first). Blocks that the marks around them alone put outside
    (an advert, a bar of links) count nothing in the scan, with their tags, so that they do not part a run, and are
    left out of it. Words in an article that are not so marked never score negatively.
    """
    if not page:
        return ""
    w = weights or fit()
    known = frozenset(w.marks)
    tokens = parse(page, known)
    has, sums = has_article(tokens), {}

    def around(marks: frozenset[str]) -> float:
        if marks not in sums:
            sums[marks] = sum(w.marks.get(m, 0.0) for m in marks)
        return sums[marks]

    texts, scores = {}, []
    for i, t in enumerate(tokens):
        if t[0] == "tag":
            scores.append(0.0 if around(t[2]) <= OUT else w.tags.get((t[1], t[3]), -0.02 if t[3] and has else -0.3))
            continue
        block = t[1]
        words, s = block.words(), around(context(block, has))
        if not words or s <= OUT:
            scores.append(0.0)
            continue
        texts[i] = words
        s = max(LEAST, min(MOST, w.bias + sum(w.words.get(f, 0.0) for f in (*block.marks, *shape(block, words)))))
        scores.append((max(s, 0.5) if has else s) * (words.count(" ") + 1))
    a, b = best_run(scores)
    return "\n".join(texts[i] for i in range(a, b) if i in texts)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page's whole html.

    A null or empty html, and one without main text, has an empty text. Repeated and null ids keep their rows; other
    columns are ignored; no rows give no rows.
    """
    small_batches(pages.sparkSession)
    weights = fit()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
