"""Text of page containers against a parser that reads the page tag by tag."""

import html
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text

CONTAINERS = (("div", "content"), ("article", ""), ("div", "main-content"))


class Reader(HTMLParser):
    """Text of the page and, per container, of the first one from its start tag to the end tag of the same depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.found, self.depth, self.silent = [], {}, {}, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
            return
        values = dict(attrs)
        for mark in CONTAINERS:
            if tag != mark[0]:
                continue
            if mark in self.found:
                if self.depth[mark]:
                    self.depth[mark] += 1
            elif not mark[1] or mark[1] in (values.get("class"), values.get("id")):
                self.found[mark], self.depth[mark] = [], 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
            return
        for mark in self.found:
            if tag == mark[0] and self.depth[mark]:
                self.depth[mark] -= 1

    def handle_data(self, data):
        if not self.silent:
            self.page.append(data)
            for mark, depth in self.depth.items():
                if depth:
                    self.found[mark].append(data)


def read(page, least):
    if page is None:
        return None
    reader = Reader()
    reader.feed(page)
    reader.close()
    for mark in CONTAINERS:
        out = "".join(reader.found.get(mark, []))
        if len(out.strip()) > least:
            return out
    return "".join(reader.page)


def made(r, depth=0):
    parts = []
    for _ in range(r.randrange(1, 6)):
        kind = r.choice(("word", "word", "div", "content", "main", "article", "p", "script", "comment", "ref", "br"))
        inner = made(r, depth + 1) if depth < 4 else "end"
        parts.append({
            "word": r.choice(("alpha ", "beta, ", "中文 ", "\n\tx ")) * r.randrange(1, 5), "div": f"<div class='other'>{inner}</div>", "content": f'<div  class="content">{inner}</div >',
            "main": f"<DIV id=main-content>{inner}</DIV>", "article": f"<article>{inner}</article>", "p": f"<p>{inner}</p>", "script": "<script>var a = '<div class=\"content\">';</script>",
            "comment": "<!-- <article> -->", "ref": "a &amp; b &lt;c&gt; &#65; &#x4e2d; &nbsp;&unknown; & ", "br": "<br/>"}[kind])
    return "".join(parts)


@pytest.mark.parametrize("least", [0, 8, 60])
def test_containers_equal_a_parser(spark, least):
    r = random.Random(least)
    pages = [made(r) for _ in range(400)] + [None, "", "no markup", "<div class=content>open", "<article>a<article>b</article>c", "<divider>x</divider>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    got = {x.i: x.body for x in df.select("i", text.body_text("html", CONTAINERS, least).alias("body")).collect()}
    for i, page in enumerate(pages):
        assert got[i] == read(page, least), page


def test_references(spark):
    names = "".join(f"&{n};" for n in text.REFERENCES) + "&#0;&#55296;&#1114112;&#128578;&#X1F642;&none;&;&#;"
    row = spark.createDataFrame([(names,)], "t string").select(text.unescaped("t").alias("t")).first()
    assert row.t == re.sub("&none;|&;|&#;", lambda m: m.group(), html.unescape(names))


def test_no_python_in_the_plan(spark):
    import plans

    plan = plans.plan_of(spark.createDataFrame([("x",)], "html string").select(text.body_text("html", CONTAINERS)))
    assert "Python" not in plan and "Arrow" not in plan
    assert F.lit(1) is not None
