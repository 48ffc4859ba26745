"""Main content of nested and broken pages, next to a parser that keeps a tree."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lexlake.functions import text as T
from lexlake.operators import html as H

VOID = {"br", "img"}


class Tree(HTMLParser):
    """Elements as [tag, attributes, children]; a closing tag closes up to its element."""

    def __init__(self, html):
        super().__init__()
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def find(node, tag, name=None, value=None):
    for child in node[2]:
        if isinstance(child, list):
            if child[0] == tag and (name is None or value in child[1].get(name, "").split()):
                return child
            hit = find(child, tag, name, value)
            if hit:
                return hit


def texts(node):
    out = []
    for child in node[2]:
        if isinstance(child, str):
            out += [child.strip()] if child.strip() else []
        elif child[0] not in ("nav", "footer", "script", "style", "aside") and not (child[0] in ("div", "ol") and "breadcrumb" in child[1].get("class", "").split()):
            out += texts(child)
    return out


def expected(html):
    root = Tree(html).root
    hit = find(root, "main") or find(root, "div", "id", "wb-main") or find(root, "div", "class", "container")
    return ("\n".join(texts(hit)), False) if hit else ("", True)


def page(rng, depth=0):
    """Well-formed, deeply nested."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "div", "nav", "aside", "p", "crumb", "ol", "br", "footer", "script"]) if depth < 6 else "text"
        if kind == "text":
            out.append(f" t{rng.randrange(1000)} ")
        elif kind == "br":
            out.append("<br>")
        elif kind == "crumb":
            tag = rng.choice(["div", "ol"])
            out.append(f'<{tag} class="x breadcrumb">{page(rng, depth + 1)}</{tag}>')
        elif kind == "script":
            out.append("<script>var a = 'x';</script><!-- </div> <nav> -->")
        else:
            name = kind.upper() if rng.random() < 0.2 else kind
            out.append(f"<{name} data-x='1'>{page(rng, depth + 1)}</{name}>")
    return "".join(out)


def test_main_content_next_to_a_tree(spark):
    rng = random.Random(6)
    wraps = ["<main>{}</main>", '<div id="wb-main">{}</div>', '<div class="a container b">{}</div>', "<section>{}</section>", "<div><main role='x'>{}</main></div><div>out</div>"]
    rows = [f"<html><body>before {rng.choice(wraps).format(page(rng))} after<div>more</div></body></html>" for _ in range(120)]
    rows += [
        "<main>a<nav>b<nav>c</nav>d</nav>e</main>", '<main>a<div class="breadcrumb">b<div>c</div>d</div>e<div>f</div></main>',
        '<div class="container">a<div>b</div>c</div>d</div>e', "<main>a</nav>b</div>c</main>", "<main>a<aside>b", "<main>" + "<div>x" * 300 + "</div>" * 300 + "y</main>z",
        "<main>a<main>b</main>c</main>d", "", "<main></main>", "<navy>x</navy><main>k<navigation>l</navigation></main>"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, html string").withColumn("url", F.lit("u"))
    got = {r["page_id"]: (r["text"], r["root_missing"]) for r in H.main_content(df).collect()}
    for i, html in enumerate(rows):
        assert got[i] == expected(html), html


def test_scan_runs_over_blocks(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000)], "v array<int>")
    out = df.select("v", T.scan(F.col("v"), F.lit(5), lambda a, x: (a + x).cast("int")).alias("s")).collect()
    for r in out:
        assert r["s"] == [5 + sum(r["v"][: i + 1]) for i in range(len(r["v"]))]
