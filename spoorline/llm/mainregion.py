"""Main text of a web page: the best-scoring stretch of its words and tags.

A page is a sequence of words and tags. Every word scores by where it stands, every tag
costs; one linear scan finds the contiguous stretch with the highest sum, and the text is
what stands in it, without the parts that are never main text (menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles, comments).

The scores are learned from labelled pages: those that mark their article themselves
(`article` or `main`) label their own words. A place is named by its nearest container
and that container's class words; its score is the log odds of being inside, cut to
[-1, 1]. A tag costs what its log odds say, at least `LEAST_COST`. At most about `sample`
pages are read for that, chosen by a hash of their id. A place never seen scores 1, or -1
where its name holds one of the words in `CHROME`.

A null page counts as empty. A page without words gives the empty text. Ends that are
missing are tolerated: a container ends with the one around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches

LEAST_COST = 0.01
SAMPLE = 2000

# Elements by their part in a page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SKIPPED = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset",
    "svg", "math", "canvas", "object", "video", "audio", "map", "datalist",
}
MAIN = {"article", "main"}
CONTAINERS = SKIPPED | MAIN | {"html", "body", "div", "section", "table", "ul", "ol", "dl", "figure", "details", "center"}
BLOCKS = CONTAINERS - {"label", "button", "select", "svg", "math", "canvas", "object", "video", "audio", "map"} | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption",
    "blockquote", "pre", "address", "figcaption", "hr", "summary", "legend", "optgroup", "option", "hgroup", "search",
}
CHROME = {
    "ad", "ads", "alert", "aside", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "hidden", "login",
    "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search",
    "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toc",
    "toolbar", "topbar", "widget",
}
ABOUT = {"no", "non", "has", "with", "without"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>\"']*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<odd>/?[a-zA-Z][^>]*)>|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Place:
    """An open container: its name, what it is known by, whether its text can count."""

    name: str
    key: str
    skipped: bool
    inside: int  # 2 within an article, 1 within the main element, else 0


@dataclass
class Weights:
    places: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)


def key_of(name: str, rest: str) -> tuple[str, bool, bool]:
    """A container's key, whether it is chrome by its names, whether it is not shown."""
    words: set[str] = set()
    unseen = False
    for m in ATTRIBUTE.finditer(rest) if "=" in rest or "hidden" in rest else ():
        what, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if what in ("class", "id"):
            found = [w.lower() for w in WORDS.findall(value)]
            # A layout that says it has or lacks a sidebar is none.
            words.update(w for before, w in zip(["", *found], found, strict=False) if before not in ABOUT)
        elif what == "role":
            words.update({"role"} if value.lower() in ROLES else ())
        elif what == "hidden" or (what == "aria-hidden" and value.lower() == "true"):
            unseen = True
        elif what == "style" and re.search(r"display\s*:\s*none", value, re.I):
            unseen = True
    chrome = bool(words & CHROME) or "role" in words
    return ".".join([name, *sorted(words)]), chrome, unseen


def parse(page: str) -> list[tuple]:
    """Tokens (tag or None, place's key, level of marked article, skipped, text, block).

    Text comes with its references decoded; the block number grows at each block's edge.
    """
    out: list[tuple] = []
    stack = [Place("", "", False, 0)]
    block, at, end = 0, 0, len(page)
    low = None
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["cdata"]
        top = stack[-1]
        if text is not None:
            out.append((None, top.key, top.inside, top.skipped, html.unescape(text) if m["text"] else text, block))
            continue
        name = m["name"] or m["odd"]
        if not name:
            continue
        name = name.strip("/").split()[0].lower() if not m["name"] else name.lower()
        closing = m["end"] == "/" or (not m["name"] and m["odd"].startswith("/"))
        rest = m["rest"] or ""
        if not closing and name in RAW:
            low = page.lower() if low is None else low
            stop = low.find(f"</{name}", at)
            at = end if stop < 0 else (page.find(">", stop) + 1 or end)
            continue
        if name in BLOCKS:
            block += 1
        if name == "br":
            out.append((None, top.key, top.inside, top.skipped, " ", block))
            continue
        out.append((name, top.key, top.inside, top.skipped, "", block))
        if name not in CONTAINERS:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        elif not rest.endswith("/"):
            key, chrome, unseen = key_of(name, rest)
            if name == "body":
                stack = [p for p in stack if p.name in ("", "html")]
            elif name in MAIN and not chrome:
                # A marked article is not part of a notice or menu left open before it.
                while any(p.skipped for p in stack) and not any("comment" in p.key for p in stack):
                    stack.pop()
            top = stack[-1]
            own = name in SKIPPED or (chrome and name not in ("html", "body", "main")) or unseen
            level = max(top.inside, {"article": 2, "main": 1}.get(name, 0))
            stack.append(Place(name, key, top.skipped or own, 0 if own and name in MAIN else level))
    return out


def learn(counts: Counter) -> Weights:
    """Weights from counts of (kind, key, inside): log odds."""
    out = Weights()
    for kind, key in {(k, x) for k, x, _ in counts}:
        odds = math.log((counts[kind, key, True] + 0.5) / (counts[kind, key, False] + 0.5))
        if kind == "word":
            out.places[key] = max(-1.0, min(1.0, odds))
        else:
            out.tags[key] = min(-LEAST_COST, odds / 10)
    return out


def marked_level(tokens: list[tuple]) -> int:
    """The innermost kind of marked article that holds text, 0 for none."""
    return max((inside for _, _, inside, skipped, text, _ in tokens if not skipped and text.strip()), default=0)


def observed(page: str) -> Counter:
    """What a page that marks its article tells: counts of (kind, key, inside)."""
    tokens = parse(page)
    level = marked_level(tokens)
    counts: Counter = Counter()
    for tag, key, inside, skipped, text, _ in tokens if level else ():
        if skipped:
            continue
        if tag:
            counts["tag", tag, inside >= level] += 1
        elif text.strip():
            counts["word", key, inside >= level] += len(text.split())
    return counts


def fit(pages: DataFrame, id: str = "page_id", page: str = "html", sample: int = SAMPLE) -> Weights:
    """Counts over at most about `sample` pages, summed by Spark."""
    bounded_batches(pages.sparkSession)
    rows = pages.count()
    known = pages
    if rows > sample:
        known = pages.where(F.pmod(F.xxhash64(id), F.lit(1_000_000)) < int(1e6 * sample / rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["t"]:
                counts.update(observed(text or ""))
            rows = [(*key, n) for key, n in counts.items()]
            yield pd.DataFrame(rows, columns=["kind", "key", "inside", "n"]).astype({"inside": bool, "n": "int64"})

    kind = "kind string, key string, inside boolean, n long"
    # A row for each kind of place or tag in the sampled pages.
    seen = known.select(F.col(page).alias("t")).mapInPandas(run, kind).groupBy("kind", "key", "inside").sum("n")
    return learn(Counter({(a, b, c): n for a, b, c, n in seen.collect()}))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous stretch with the highest positive sum."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def extract(page: str, weights: Weights) -> str:
    """The page's main text: blocks joined by line feeds."""
    tokens = parse(page)
    level = marked_level(tokens)
    scores = []
    for tag, key, inside, skipped, text, _ in tokens:
        if skipped:
            # What is left out inside an article does not part it.
            score = 0.0 if tag or (level and inside >= level) else -1.0
        elif tag:
            score = weights.tags.get(tag, -LEAST_COST)
        else:
            score = weights.places.get(key, 1.0) if inside >= level else -1.0
        scores.append(score if tag else score * len(text.split()))
    first, last = best_stretch(scores)
    blocks: dict[int, list[str]] = {}
    for tag, _, inside, skipped, text, block in tokens[first:last]:
        if not tag and not skipped and inside >= level:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def main_text(page: Column, weights: Weights) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(x or "", weights) for x in pages], dtype=object)

    return run(page)


def extract_pages(pages: DataFrame, weights: Weights, page: str = "html") -> DataFrame:
    """Adds `text` and its length in code points, `n_chars`."""
    return pages.withColumn("text", main_text(F.col(page), weights)).withColumn("n_chars", F.length("text").cast("long"))
