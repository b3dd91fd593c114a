"""Main text of pages against an independent parser, planted pages and the tree's own predictions."""

import html
import re
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strandframe.llm import maintext

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark):
    return maintext.learn(maintext.labelled_blocks(spark))


def _run(spark, tree, pages):
    rows = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in maintext.extract(rows, tree).collect()}
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == f"u{i}" for i, r in got.items())
    return [got[i]["text"] for i in range(len(pages))]


W = "Some words of a longer paragraph that goes on for a while, as articles do, with a second clause."
CASES = [
    (None, ""),
    ("", ""),
    ("   \n", ""),
    ("<article></article>", ""),
    (f"<article><p>{W}<p>One.</article>", f"{W}\nOne."),
    (f"<article><p><b>{W}<br></article><footer>&copy; x</footer>", W),
    ("<article><p>a&amp;b &lt;p&gt; &#x41;&#66;&nbsp;c  d\n\te</p></article>", "a&b <p> AB c d e"),
    (f"<article><header><h1>Title</h1></header><p>{W}</p><footer>Tags</footer></article>", f"Title\n{W}"),
    (f"<body><header><p>Site name and its long line of what it is about</p></header><main><p>{W}</p></main></body>", W),
    (f'<main><p>{W}</p><div class="comments"><article><p>{W} I agree.</p></article></div></main>', W),
    (f'<div id="comments"><p>{W}</p></div><div class="post-content"><p>{W} 2</p></div>', f"{W} 2"),
    (f'<div class="cookie-banner" role="dialog"><p>{W}</p></div><main>{W} 3</main>', f"{W} 3"),
    (f'<form><p>{W}</p><input name="q"><button>Go</button></form><article><p>{W} 4</p></article>', f"{W} 4"),
    (f"<form><article><p>{W} 5</p><select><option>x</select><textarea>y</textarea></article></form>", f"{W} 5"),
    (f"<aside><p>{W}</p></aside><article><p>{W} 6</p><aside>{W}</aside></article>", f"{W} 6"),
    (f"<article><p>{W}</p><script>var t='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><noscript>no</noscript></article>", W),
    (f'<article><p hidden>no</p><p style="display: none">no</p><p>{W}</p></article>', W),
    (f"<h1>A headline of some words</h1><p>{W}</p><p>{W}</p>", f"A headline of some words\n{W}\n{W}"),
    ("<ul>" + "<li><a href='/x'>Menu</a></li>" * 6 + f"</ul><p>{W}</p><p>Yes.</p><p>{W}</p>", f"{W}\nYes.\n{W}"),
    (f'<article class="no-sidebar"><p>{W}</p></article><div class="related"><ul><li><a href=x>{W}</a></ul></div>', W),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x  y</pre><blockquote>{W}</blockquote></article>", f"one\ntwo\na\nb\nx y\n{W}"),
    (f"<article><p>1 < 2 and 3 > 2</p><p>{W}</p><p title='a > b' class=x>{W}", f"1 < 2 and 3 > 2\n{W}\n{W}"),
    (f"<article><p>{W}</p><p <a <a <a", W),
    ("<ARTICLE><P>ÀÉ 中文 😀</P></ARTICLE>", "ÀÉ 中文 😀"),
]


def test_cases(spark, tree):
    got = _run(spark, tree, [h for h, _ in CASES])
    for (page, want), text in zip(CASES, got, strict=True):
        assert text == want, page


def test_long_page_repeated_rows_and_empty_table(spark, tree):
    page = "<article>" + f"<p>{W}</p>" * 20000 + "</article>"
    assert _run(spark, tree, [page, "<p><a " * 50000, "<" * 100000]) == ["\n".join([W] * 20000), "", "<" * 100000]
    rows = spark.createDataFrame([(None, None, f"<main>{W}</main>")] * 2, "page_id long, url string, html string")
    assert [tuple(r) for r in maintext.extract(rows, tree).collect()] == [(None, None, W, len(W))] * 2
    assert maintext.extract(rows.limit(0), tree).count() == 0


class _Blocks(HTMLParser):
    """Blocks of pages that close what they open, or leave p and b open."""

    def __init__(self):
        super().__init__()
        self.blocks, self.now, self.skip = [], "", 0

    def _end(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag in maintext.BLOCK:
            self._end()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag in maintext.BLOCK:
            self._end()

    def handle_data(self, data):
        if not self.skip:
            self.now += data


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_tables_against_another_parser_and_the_articles(spark, tree):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    of = {r["page_id"]: r["html"] for r in pages.collect()}
    cut = {r["page_id"]: [b["text"] for b in r["judged"]] for r in maintext.judged(pages, tree).collect()}
    text = {r["page_id"]: r["text"] for r in maintext.op13_html_extraction(spark, SF).collect()}
    for i, page in of.items():
        parser = _Blocks()
        parser.feed(page)
        parser.close()
        parser._end()
        assert cut[i] == parser.blocks
        article = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert text[i] == "\n".join(x for x in blocks if x)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_expression_is_the_tree(spark, tree):
    blocks = maintext.judged(spark.read.parquet(f"{SF}/pages.parquet"), tree).select(F.explode("judged").alias("b")).select("b.*")
    every = blocks.select("main", "f").unionByName(
        maintext.labelled_blocks(spark).select(maintext.expression(tree, F.col("f")).alias("main"), "f")
    )
    judged = tree.transform(every.withColumn("features", array_to_vector("f")))
    assert judged.filter(F.col("main") != (F.col("prediction") > 0.5)).count() == 0
    table = tree.transform(maintext.labelled_blocks(spark).withColumn("features", array_to_vector("f")))
    assert table.filter("label = prediction").count() >= 0.97 * table.count()
