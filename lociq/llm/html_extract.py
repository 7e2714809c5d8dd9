"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks; block-level tags end a block, inline
tags do not.  A block has its number of words and its link density (share of
words inside links), those of the blocks before and after it, and what the
elements around it say (``FEATURES``).  A decision tree (``pyspark.ml``) is fitted on the
small labelled table ``page_examples.txt``: pages in a short notation, in which blocks of the
article start with a section sign.  The table is fixed, so the tree is too; it is
turned into a column expression over the blocks.

Every page is read whole and on its own, so nothing is shuffled.  Null and empty
pages give an empty text; tags that are never closed, broken attributes and
pages cut anywhere are read as far as they go.  Repeated rows get the same
text.  Added columns whose names are taken get a number.  An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import html
import re
from pathlib import Path

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import fresh

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "boiler",  # in an element that says menu, footer, sidebar, notice, advert and the like
    "comment",  # in an element that holds readers' comments
    "form",
    "inside",  # 2 in an article or main element, 1 in one whose class or id says content, post, text and the like
    "heading", "item",
    "elsewhere",  # not in an article or main element, but the page has one with text
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=\s|/|$)""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is never read.
_RAW = {"script", "style", "title", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "button", "canvas", "audio", "video", "noframes", "datalist"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are followed until their end tag.
_CONTAINER = set("address article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table tbody td tfoot th thead tr ul".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ITEMS = {"li", "dt", "dd", "td", "th", "option", "summary"}
_BOILER_TAGS = {"nav", "aside", "footer", "menu", "dialog"}
_BOILER_WORDS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer foot sidebar side rail widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion popup modal overlay cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations teaser teasers pagination pager paging toolbar topbar skip copyright imprint disclaimer search outbrain taboola".split())
_COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond responses discussion feedback".split())
_CONTENT_WORDS = set("article content main post entry story body text prose".split())

# bits of what the elements around a block say
_BOILER, _COMMENT, _FORM, _ARTICLE, _CONTENT, _HIDDEN = (1 << k for k in range(6))


def _says(tag: str, attributes: str, around: int) -> int:
    """The bits inside an element, given those around it."""
    words, hidden, role = set(), False, ""
    for name, *values, bare in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values)
        name = name.lower()
        if bare or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            words |= {w.lower() for w in _TOKEN.findall(value)}
    if hidden:
        return around | _HIDDEN
    if words & _COMMENT_WORDS:
        return around | _COMMENT
    if tag == "form" or role in ("form", "search"):
        return around | _FORM
    page_header = (tag == "header" or role == "banner" or "header" in words or "head" in words) and not around & (_ARTICLE | _CONTENT) and not words & _CONTENT_WORDS
    wrapper = words & _CONTENT_WORDS and words & {"wrap", "wrapper", "has", "with"}
    if tag == "main" or role == "main":
        return (around | _ARTICLE) & ~(_FORM | _BOILER)
    if tag in _BOILER_TAGS or (words & _BOILER_WORDS and not wrapper) or page_header or role in ("navigation", "complementary", "contentinfo", "alert", "dialog", "menu"):
        return around | _BOILER
    if tag == "article" or role == "article":
        return (around | _ARTICLE) & ~_FORM
    if words & _CONTENT_WORDS:
        return around | _CONTENT
    return around


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, features) of a page's text blocks, in page order."""
    page = page or ""
    found: list[tuple[str, int, int, int, bool, bool]] = []  # text, words, linked words, bits, heading, item
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    linked: list[str] = []
    bits = own = 0
    heading = item = False
    links = 0

    def end_block() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words and not own & _HIDDEN:
                n = len(html.unescape("".join(linked)).split())
                found.append((" ".join(words), len(words), min(n, len(words)), own, heading, item))
            text.clear()
            linked.clear()

    at, end = 0, len(page)
    lower = None
    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked.append(piece)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not closes and not m[3].endswith("/"):
                lower = page.lower() if lower is None else lower
                k = lower.find(f"</{tag}", at) if len(lower) == end else re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
                k = k if isinstance(k, int) else k.start() if k else -1
                if k >= 0:
                    close = page.find(">", k)
                    at = end if close < 0 else close + 1
                elif tag in ("script", "style"):
                    at = end
            text.append(" ")
        elif tag == "a":
            links = 0 if closes else 1
            linked.append(" ")
        elif tag == "br":
            text.append(" ")
            if links:
                linked.append(" ")
        elif tag in _BLOCK:
            end_block()
            heading = tag in _HEADINGS and not closes
            item = tag in _ITEMS and not closes
            if tag in _CONTAINER:
                if closes:
                    k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                    if k >= 0:
                        bits = stack[k][1]
                        del stack[k:]
                else:
                    stack.append((tag, bits))
                    bits = _says(tag, m[3], bits)
                own = bits
            else:
                own = bits if closes or not m[3] or tag in ("html", "head", "body") else _says(tag, m[3], bits)
            links = 0
    end_block()
    has_article = any(f[3] & _ARTICLE and not f[3] & (_BOILER | _COMMENT) for f in found)
    shape = [(float(n), k / n) for _, n, k, *_ in found]
    out = []
    for k, (what, _, _, own, head, li) in enumerate(found):
        before = shape[k - 1] if k else (0.0, 0.0)
        after = shape[k + 1] if k + 1 < len(shape) else (0.0, 0.0)
        said = [*(float(bool(own & b)) for b in (_BOILER, _COMMENT, _FORM)), 2.0 if own & _ARTICLE else float(bool(own & _CONTENT))]
        out.append((what, [*shape[k], *before, *after, *said, float(head), float(li), float(has_article and not own & _ARTICLE)]))
    return out


MARK = "§"


def examples() -> list[tuple[int, list[float], float]]:
    """The labelled table: (page, features, 1 for blocks of an article) of all blocks of ``page_examples.txt``.

    ``{n}`` stands for n words and ``{an}`` for a link of n words.
    """
    text = (Path(__file__).parent / "page_examples.txt").read_text()
    out = []
    for k, page in enumerate(text.split("\n====\n")):
        page = re.sub(r"\{a(\d+)\}", lambda m: f'<a href="/x">{"word " * int(m[1])}</a> ', page)
        page = re.sub(r"\{(\d+)\}", lambda m: "word " * int(m[1]), page)
        labels = [float(what.startswith(MARK)) for what, _ in blocks(page)]
        out += [(k, features, label) for (_, features), label in zip(blocks(page.replace(MARK, "")), labels, strict=True)]
    return out


def fit(spark: SparkSession, table: list[tuple[int, list[float], float]], depth: int = 10) -> tuple | float:
    """A tree: (feature, threshold, tree if at most, tree if above), or a label."""
    rows = spark.createDataFrame([(f, label) for _, f, label in table], "f array<double>, label double").coalesce(1)
    fitted = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(rows.select("label", array_to_vector("f").alias("features")))

    def plain(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), plain(node.leftChild()), plain(node.rightChild())

    return plain(fitted._call_java("rootNode"))


@functools.cache
def _fitted(application: str, depth: int) -> tuple | float:
    return fit(SparkSession.active(), examples(), depth)


def tree(spark: SparkSession, depth: int = 10) -> tuple | float:
    """The tree fitted on the labelled table, once for an application."""
    return _fitted(spark.sparkContext.applicationId, depth)


def in_article(node, features: Column) -> Column:
    """The tree as a condition on an array of features."""
    if not isinstance(node, tuple):
        return F.lit(node > 0.5)
    k, threshold, low, high = node
    return F.when(features[k] <= threshold, in_article(low, features)).otherwise(in_article(high, features))


BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType()))]))
#: Pages handed over at once.
BATCH = 256


def with_blocks(pages: DataFrame, html_col: str, name: str) -> DataFrame:
    """``pages`` without their html, with a column of text blocks and their features."""
    fields = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*fields, T.StructField(name, BLOCKS)])
    keep = [k for k, c in enumerate(pages.columns) if c != html_col]
    at = pages.columns.index(html_col)
    kind = pa.list_(pa.struct([pa.field("text", pa.string()), pa.field("features", pa.list_(pa.float64()))]))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                found = pa.array([[{"text": t, "features": f} for t, f in blocks(page.as_py())] for page in part.column(at)], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found], names=schema.fieldNames())

    return pages.mapInArrow(run, schema)


def extract(pages: DataFrame, html_col: str = "html", depth: int = 10) -> DataFrame:
    """``pages`` with text (blocks of the article, joined by two newlines) and n_chars, instead of the html."""
    blocks_col = fresh(pages.columns, "__blocks")
    others = [c for c in pages.columns if c != html_col]
    node = tree(pages.sparkSession, depth)
    found = with_blocks(pages, html_col, blocks_col)
    kept = F.filter(F.col(f"`{blocks_col}`"), lambda b: in_article(node, b["features"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    text_name = fresh(others, "text")
    out = found.select(*(F.col(f"`{c}`") for c in others), text.alias(text_name))
    return out.withColumn(fresh(out.columns, "n_chars"), F.length(F.col(f"`{text_name}`")).cast("long"))
