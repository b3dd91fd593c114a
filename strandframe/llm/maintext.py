"""Main text of web pages: flat text blocks, each judged by a decision tree from its own and its neighbours' word counts and link densities.

A page is cut at its block-level tags into flat blocks. A block has its text, its words, how many of them are linked, whether it is a heading, whether
an element around it is marked as the content (``article``, ``main``, a class, id or role that says so) and whether one is marked as something else
(menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts). The tree sees these of the block, and word count and link density of the blocks
before and after it. It is a Spark ML decision tree, trained on the small labelled table that ``labelled_blocks`` lays out from a few page plans, and
is turned into one column expression: blocks are cut in Arrow batches, everything else runs on arrays inside the row, so pages are never shuffled.

Scripts, styles, comments and other unread elements give no block; a line break (``br``) is white space inside its block; character references are
decoded; blocks without a character other than white space aren't blocks. Null or empty html gives empty text and 0; repeated rows give repeated
results; page_id and url pass as they are, null ones too, other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import html as html_std
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Elements that begin and end a block (the rest are inline), elements whose content is never read, elements without content.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html iframe legend li main menu nav noframes noscript ol option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split()
)
UNREAD = "script|style|title|textarea|template|svg|math|iframe|object|canvas|select|datalist|noembed|noframes|noscript|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these, by its own name.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# What elements, roles, and words of class and id say about their content.
OUTSIDE_TAGS = frozenset("nav footer aside button dialog label legend menu search".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary footer "
    "contentinfo masthead topbar cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social comment comments commentlist "
    "reply replies disqus respond discussion related recommended widget widgets toolbar pagination pager copyright legal disclaimer search skip paywall".split()
)
INSIDE_TAGS = frozenset(("article", "main"))
INSIDE_WORDS = frozenset("article main content contents post entry story articlebody maincontent bodytext".split())
_NOT_WORDS = frozenset(("no", "has", "with", "without"))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{UNREAD})(?=[\s/>])(?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s|[\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*|'[^']*|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Of a block: text, words, linked words, heading, content mark, other mark.
BLOCK_TYPE = pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("heading", pa.int32()), ("inside", pa.int32()), ("outside", pa.int32())])
BLOCK_SQL = "struct<text:string,words:int,linked:int,heading:int,inside:int,outside:int>"
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "inside", "outside")


def _marks(name: str, attributes: str, in_content: bool) -> tuple[bool, bool]:
    """Whether an element marks its content as the page's content, and as something else."""
    inside, outside = name in INSIDE_TAGS, name in OUTSIDE_TAGS or (name == "header" and not in_content)
    if attributes and name not in ("html", "body"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                outside = True
            elif key in ("class", "id", "role"):
                for part in value.split():
                    words = [w.lower() for w in _WORD.findall(part)]
                    if not _NOT_WORDS.isdisjoint(words):
                        continue
                    outside |= not OUTSIDE_WORDS.isdisjoint(words) or (("header" in words or "banner" in words) and not in_content)
                    inside |= not INSIDE_WORDS.isdisjoint(words)
    return inside and not outside, outside


def cut_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """The flat blocks of one page, in BLOCK_TYPE's order. One pass; an element left open ends with the one around it."""
    blocks: list[tuple[str, int, int, int, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, in content, in something else, in a form

    def flush(heading: bool = False) -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                top = stack[-1] if stack else ("", False, False, False)
                blocks.append((" ".join(words), len(words), len("".join(linked).split()), int(heading), int(top[1]), int(top[2] or top[3])))
            parts.clear()
            linked.clear()

    def pop_to(at: int) -> None:
        flush(stack[-1][0] in HEADINGS)
        del stack[at:]

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            piece = html_std.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if any(x[0] == "a" for x in stack[-3:]):
                linked.append(piece)
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if found is not None:
                if name == "a":
                    linked.append(" ")
                    del stack[found]
                else:
                    pop_to(found)
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            stack[:] = [x for x in stack[:-3]] + [x for x in stack[-3:] if x[0] != "a"]
            linked.append(" ")
            stack.append(("a", *(stack[-1][1:] if stack else (False, False, False))))
            continue
        if name not in BLOCK:
            continue
        flush(bool(stack) and stack[-1][0] in HEADINGS)
        for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):  # what the tag ends, if open just above
            if stack[i][0] == "p" or stack[i][0] in ENDS.get(name, ()):
                del stack[i:]
            elif stack[i][0] in BLOCK and stack[i][0] not in ENDS.get(name, ()):
                break
        if name in VOID:
            continue
        _, content, other, form = stack[-1] if stack else ("", False, False, False)
        inside, outside = _marks(name, token["attributes"], content)
        if name in INSIDE_TAGS:
            form = False
        stack.append((name, content or inside, other or outside, form or name in ("form", "fieldset")))
    if at < len(page):
        parts.append(html_std.unescape(page[at:]))
    flush(bool(stack) and stack[-1][0] in HEADINGS)
    return blocks


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of pages, and blocks, the array of the flat blocks of html."""
    kept = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(BLOCK_TYPE)
        for batch in batches:
            for part in common.text_slices(batch, html):
                cut = [[dict(zip(BLOCK_TYPE.names, b, strict=True)) for b in cut_blocks(t.decode("utf-8", "replace"))] for t in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(cut, type=kind)], names=[*kept, "blocks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)
    return pages.select(*kept, F.col(html).cast("string").alias(html)).mapInArrow(run, f"{fields}, blocks array<{BLOCK_SQL}>")


def features(blocks: Column) -> Column:
    """Of an array of blocks: an array of structs of the block's text and FEATURES, in their order."""
    words = lambda b: F.coalesce(b["words"], F.lit(0)).cast("double")
    density = lambda b: F.coalesce(b["linked"] / F.greatest(b["words"], F.lit(1)), F.lit(0.0))

    def of(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        values = [words(b), density(b), words(before), density(before), words(after), density(after), *(b[k].cast("double") for k in ("heading", "inside", "outside"))]
        return F.struct(b["text"].alias("text"), F.array(*values).alias("f"))

    return F.transform(blocks, of)


def labelled_pages() -> list[tuple[str, list[int]]]:
    """The labelled table: pages laid out from a few plans, with the label of each block (1: main text)."""
    text = lambda n: " ".join(["word"] * n)
    links = lambda n, m=1: "<ul>" + "".join(f'<li><a href="/x">{text(m)}</a></li>' for _ in range(n)) + "</ul>"
    #: Content around the article's blocks: marked by an element, by a class, or not at all.
    around = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ("<article><div>", "</div></article>"), ("<div>", "</div>"), ("<td>", "</td>")]
    marked = [("<nav>", "</nav>"), ('<div class="ad">', "</div>"), ("<footer>", "</footer>"), ("<aside>", "</aside>"), ('<div id="comments">', "</div>"), ("<form>", "</form>"), ('<div class="cookie-notice">', "</div>")]
    bodies = [[7, 60, 1, 45], [4, 25, 30, 3, 28], [9, 120, 20], [5, 3], [3, 18, 16, 2, 40, 1], [6, 1, 1, 35], [8, 50, 14, 90]]
    out = []
    for i, (body, (begin, end)) in enumerate((b, a) for b in bodies for a in around):
        plain = begin in ("<div>", "<td>")
        if plain and len(body) == 2 and body[1] < 10:
            continue  # nothing tells such a page's text from its notices
        parts: list[tuple[str, list[int]]] = []
        parts.append((links(4 + i % 3, 1 + i % 2), [0] * (4 + i % 3)) if i % 2 else (f"<nav>{links(5)}</nav>", [0] * 5))
        first, last = marked[i % len(marked)], marked[(i + 3) % len(marked)]
        if i // 6 % 2:  # else the content follows the links
            parts.append((f"{first[0]}<p>{text(3 + 5 * (i % 4))}</p>{first[1]}", [0]))
            parts.append((f"{last[0]}<p>{text(40)}</p><p>{text(2 + i % 9)}</p>{last[1]}", [0, 0]))
        own = "".join(f"<p>{text(n)}</p>" for n in body[1:])
        labels = [1] * (len(body) - 1)
        if i // 6 % 3 != 2:  # else there is no headline
            own, labels = f"<h1>{text(body[0])}</h1>{own}", [1, *labels]
        if i % 3 == 0:  # a list of other pages, and an advert, within
            own += links(4, 3) + f'<div class="advert">{text(12)}</div>'
            labels += ([0] if plain else [1]) * 4 + [0]
        parts.append((begin + own + end, labels))
        if i % 2:
            parts.append((f"<div>{links(6, 2)}</div>", [0] * 6))
        if plain:
            parts.append((f'<p>{text(3)} <a href="/">{text(2)}</a> <a href="/">{text(2)}</a></p>', [0]))
            parts.append((f"<h3>{text(1 + i % 3)}</h3>{links(3, 3)}<p>{text(2 + i % 4)}</p>{links(2)}", [0] * 7))  # a heading and a word between lists of links
            parts.append((f"<p>{text(4 + i % 4)}</p>", [0]))  # the last line, after links
            parts.insert(0, (f"<div>{text(2 + i % 3)}</div>", [0]))  # the site's name, before links
            parts.insert(1, (links(3), [0] * 3))
        parts.append((f"{last[0]}<div>{text(30 + i)}</div>{last[1]}", [0]))
        parts.append((f"<footer>{text(4 + i % 8)}</footer>", [0]) if i % 4 else (f'<div class="copyright">{text(5)}</div>', [0]))
        if plain:
            out.append((f"<h1>{text(body[0])}</h1>" + "".join(f"<p>{text(n)}</p>" for n in body[1:]), [1] * len(body)))  # a page of content alone
        out.append(("<html><body>" + "".join(x for x, _ in parts) + "</body></html>", [x for _, y in parts for x in y]))
    return out


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """The labelled table as rows: label and the array of FEATURES."""
    rows = spark.createDataFrame(labelled_pages(), "html string, labels array<int>")
    judged = with_blocks(rows).select(F.explode(F.arrays_zip(features(F.col("blocks")).alias("block"), F.col("labels").alias("label"))).alias("x"))
    return judged.select(F.col("x.label").cast("double").alias("label"), F.col("x.block.f").alias("f"))


def learn(table: DataFrame, depth: int = 9) -> DecisionTreeClassificationModel:
    """A decision tree over rows (label, f)."""
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1)
    return tree.fit(table.select("label", array_to_vector("f").alias("features")).coalesce(1))


def expression(model: DecisionTreeClassificationModel, f: Column) -> Column:
    """The tree's prediction for an array of FEATURES, as nested conditions."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        return F.when(F.get(f, F.lit(split.featureIndex())) <= F.lit(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._call_java("rootNode"))


def judged(pages: DataFrame, model: DecisionTreeClassificationModel) -> DataFrame:
    """page_id, url and judged: of each block in page order its text, features, and whether it is main text."""
    own = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    found = with_blocks(own).select("page_id", "url", features(F.col("blocks")).alias("blocks"))
    return found.select("page_id", "url", F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["f"].alias("f"), expression(model, b["f"]).alias("main"))).alias("judged"))


def extract(pages: DataFrame, model: DecisionTreeClassificationModel) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    kept = F.transform(F.filter("judged", lambda b: b["main"]), lambda b: b["text"])
    return judged(pages, model).select("page_id", "url", F.array_join(kept, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.docs_of(spark, sf_dir, "pages")
    return extract(pages, learn(labelled_blocks(spark)))
