"""HTML extraction by a maximum-scoring subsequence of words and tags (operator 8).

A page is a sequence of words, which score above zero, and tags, which score below; the run of
tokens with the largest sum, found in one scan, is the article. The weights are log odds from
labelled pages: those that mark their content themselves by <article> or <main>. They are summed up
over all such pages into one small table per tag. Elements whose tag or class says that they hold no
content (fixed lists below) are passed over by the scan, inside the region too, unless they hold most of
the page's words: then the form or class describes the page or its layout, and the scan decides. A class counts
if it consists of such words and of words for places and boxes alone: "share-bar" does, while
"has-sidebar", "comments-open" or "social-science" do not.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ALWAYS = frozenset("head nav aside footer menu dialog button select audio video canvas".split()) | RAW
MARKS = frozenset({"article", "main"})
CLOSES_P = BLOCKS - {"body", "html", "head", "legend", "optgroup", "option", "summary"}
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos promotion promotions sidebar sidebars "
    "comment comments replies disqus cookie cookies consent gdpr notice notices alert alerts newsletter newsletters subscribe subscription share sharing social "
    "related recommended menu menus nav navbar navigation breadcrumb breadcrumbs pagination footer popup popups modal modals overlay widget widgets login signup "
    "search toolbar skip complementary contentinfo paywall".split()
)
PLACE_WORDS = frozenset(
    "area bar block box bottom button buttons container content form global group head header icon icons inner item items left link links list main module outer "
    "page panel post posts primary region right row secondary section site slot small thread top unit wrap wrapper".split()
)
ROLE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
KNOWN = BLOCKS | frozenset("a abbr b br cite code del em font i img ins kbd mark q s small span strong sub sup time u".split())

#: Bounds of a word's and a tag's weight.
WORD, TAG = (0.05, 2.0), (-8.0, -0.1)


def parsed(page: str):
    """(kind, name, text, block, marked, asides) in page order; kind is 'word' (a stretch of text) or 'tag'.

    ``name`` is the tag, or the innermost block that the text stands in; ``marked`` says whether it
    is inside <article> or <main>; ``asides`` are the numbers of the open elements that may hold no
    content, 0 for those that surely don't. Raw elements yield nothing.
    """
    stack: list[tuple[str, int | None]] = []  # open elements and their number among the asides
    asides: tuple[int, ...] = ()
    marks = block = count = 0
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            name = next((n for n, _ in reversed(stack) if n in BLOCKS), "body")
            yield "word", name, html.unescape(text), block, marks > 0, asides
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCKS:
            block += 1
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and not (name not in BLOCKS and any(n in BLOCKS for n, _ in stack[depth + 1 :])):
                marks -= sum(n in MARKS for n, _ in stack[depth:])
                del stack[depth:]
                asides = tuple(k for _, k in stack if k is not None)
            yield "tag", name, "", block, marks > 0, asides
            continue
        if name in RAW and not attrs.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = close.end() if close else end if name in ("script", "style") else at
            continue
        if name in MARKS:
            # Content begins: what was left open and may hold none ends here.
            stack, asides = [(n, None) for n, _ in stack], ()
        elif name in CLOSES_P and stack and any(n == "p" for n, _ in stack):
            depth = max(i for i, (n, _) in enumerate(stack) if n == "p")
            if not any(n in BLOCKS for n, _ in stack[depth + 1 :]):
                del stack[depth:]
                asides = tuple(k for _, k in stack if k is not None)
        if name in VOID:
            yield ("word", name, " ", block, marks > 0, asides) if name == "br" else ("tag", name, "", block, marks > 0, asides)
            continue
        number = None
        if name in ALWAYS or (name == "header" and not marks):
            number = 0
        elif name == "form" or (name not in ("html", "body") and name not in MARKS and aside(attrs)):
            number = count = count + 1
        if number is not None:
            asides = (*asides, number)
        stack.append((name, number))
        marks += name in MARKS
        yield "tag", name, "", block, marks > 0 and name not in MARKS, asides


def tokens(page: str) -> list[tuple[str, str, str, int, bool]]:
    """(kind, name, text, block, marked) of what may be content: without asides, but for those that hold
    half of the page's words or more."""
    found = list(parsed(page))
    if not any(x[5] for x in found):
        return [x[:5] for x in found]
    held, total = Counter(), 0
    for kind, _, text, _, _, asides in found:
        if kind == "word":
            n = len(text.split())
            total += n
            for k in asides:
                held[k] += n
    whole = {k for k, n in held.items() if k and 2 * n >= total}
    return [x[:5] for x in found if all(k in whole for k in x[5])]


def aside(attrs: str) -> bool:
    """Whether class, id or role name something that isn't the article, or the element is hidden."""
    if not attrs.strip():
        return False
    named = " ".join(next(filter(None, x), "") for x in ROLE.findall(attrs))
    return any(map(names_aside, named.lower().split())) or bool(HIDDEN.search(attrs))


def names_aside(name: str) -> bool:
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=\d)", name) if p and not p.isdigit()]
    return any(p in ASIDE_WORDS for p in parts) and all(p in ASIDE_WORDS or p in PLACE_WORDS for p in parts)


def features(page: str) -> tuple[Counter, bool]:
    """Counts of (kind, name, inside) on a page, and whether it marks its content."""
    found, marked = Counter(), False
    for kind, name, text, _, inside in tokens(page):
        n = len(text.split()) if kind == "word" else 1
        found[kind, name if name in KNOWN else "other", inside] += n
        marked |= inside
    return found, marked


def weights_of(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Weights of words by block and of tags: smoothed log odds of standing inside, within their bounds."""
    out = {}
    for kind, name in {(k, n) for k, n, _ in counts}:
        odds = math.log(counts.get((kind, name, True), 0) + 0.5) - math.log(counts.get((kind, name, False), 0) + 0.5)
        low, high = WORD if kind == "word" else TAG
        out[kind, name] = min(high, max(low, odds))
    return out


def fit(pages: DataFrame) -> dict[tuple[str, str], float]:
    """Weights from all pages that mark their content by <article> or <main>."""

    def run(batches):
        for batch in batches:
            found = Counter()
            for page in batch.column(0).to_pylist():
                if page:
                    own, marked = features(page)
                    if marked:
                        found.update(own)
            rows = [(k, n, i, v) for (k, n, i), v in found.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["kind", "name", "inside", "n"])

    # One row per known tag: a few hundred at most.
    rows = pages.select(F.col("html").cast("string")).mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["kind"], r["name"], r["inside"]): r["n"] for r in rows})


def main_text(page: str, weights: dict[tuple[str, str], float]) -> str:
    """The text of the best-scoring region, blocks joined by two line feeds."""
    found = tokens(page)
    best = run = 0.0
    first = last = start = 0
    for i, (kind, name, text, _, _) in enumerate(found):
        known = name if name in KNOWN else "other"
        run += weights.get((kind, known), 0.5) * len(text.split()) if kind == "word" else weights.get((kind, known), -0.5)
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, first, last = run, start, i + 1
    blocks: dict[int, list[str]] = {}
    for kind, _, text, block, _ in found[first:last]:
        if kind == "word":
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each page.

    ``pages`` has page_id, url and html; other columns are ignored. Returns one row per input row:
    page_id, url and text. Character references are decoded, white space in a block is one space,
    blocks are joined in page order by two line feeds. A null or empty page, or one without words
    outside boilerplate, has an empty text.
    """
    weights = fit(pages)

    def run(batches):
        for batch in batches:
            out = [main_text(page, weights) if page else "" for page in batch.column(2).to_pylist()]
            out = [x.encode("utf-8", "replace").decode() for x in out]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
